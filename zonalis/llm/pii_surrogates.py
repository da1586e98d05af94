"""Personal data replaced by surrogates that are keyed, of the same type and form, distinct, and the same everywhere.

A detected entity has a kind and a canonical value (an e-mail in lower case, the digits of a phone number, ...). Its
surrogate depends only on key, kind and value, so mentions of one entity agree in all documents and no text is
shuffled. Numbers and tokens are mapped by a keyed permutation of all strings of their form, which can't give two entities
one surrogate; names come from name parts of the same script and gender, and can. A global check groups the distinct
entities by surrogate; those that collide move on to their next surrogate until none does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import Scratch, fresh_names, keyed_text, slices, small_batches

#: Moved entities that are broadcast at most; if there are more, they are joined to the documents that mention them.
MOVED_ROWS = 200_000

#: Characters that are permuted as one number: keeps the numbers small and the time linear.
SHAPED_BLOCK = 128

#: Forms of address with their gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Monsieur": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Господин": "m", "Госпожа": "f",
}
#: Parts that surrogate names are made of, by script.
NAME_PARTS = {
    "latin": {
        "m": (["Al", "Ber", "Car", "Dor", "Ed", "Fer", "Gil", "Har", "Jul", "Kon", "Leo", "Mar", "Nor", "Os", "Pet", "Rai", "Sil", "Tor", "Vik", "Wal"], ["bert", "dan", "fred", "ian", "lin", "mund", "o", "rik", "ton", "win"]),
        "f": (["Al", "Ber", "Car", "Dor", "Ed", "Fer", "Gil", "Har", "Jul", "Kon", "Leo", "Mar", "Nor", "Os", "Pet", "Rai", "Sil", "Tor", "Vik", "Wal"], ["a", "anne", "belle", "dis", "ette", "ia", "ina", "lene", "trud", "ya"]),
        "s": (["Ash", "Bran", "Cor", "Dal", "El", "Farn", "Gren", "Hol", "Kel", "Lin", "Mor", "Nev", "Ost", "Pem", "Rad", "Sten", "Thorn", "Ull", "Var", "Wick"], ["ale", "berg", "by", "dorf", "ell", "ford", "ham", "ley", "man", "mont", "ner", "sen", "stone", "ton", "wood"]),
    },
    "cyrillic": {
        "m": (["Бор", "Влад", "Дам", "Кир", "Мир", "Рад", "Свят", "Яр"], ["ан", "ел", "ир", "ислав", "омир", "ослав"]),
        "f": (["Бор", "Влад", "Дам", "Кир", "Мир", "Рад", "Свят", "Яр"], ["ана", "ела", "ина", "ислава", "омира", "ослава"]),
        "s": (["Берез", "Волк", "Дуб", "Зар", "Клён", "Лес", "Мороз", "Снег"], ["енко", "ич", "овских", "ченко", "чук", "як"]),
    },
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-."
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}")
_DIGIT = re.compile("[0-9]")
_NUMBERS = (
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w-])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)|(?<!\w)\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])")),
)
_SECRET_WORDS = ("token", "password", "passwd", "secret", "key")
_SECRET = re.compile(r"(?i:password|passwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{8,})")
_PREFIXED = re.compile(r"(?<!\w)(?:AKIA(?=[A-Z0-9]{16}(?!\w))|ghp_|sk-)([A-Za-z0-9]{16,})")
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ([A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+)(?: ([A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+))?")
_CJK_NAME = re.compile(r"([一-鿿])([一-鿿]{1,2})(先生|女士|小姐)")
_WORD = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞА-ЯЁ]\w*(?:[-'’]\w+)*")
#: Given names of a later attempt are of one of these stretches of ideographs, in which signs of one radical stand together.
CJK_STRETCH = {"m": (0x5C71, 0x5DD4), "f": (0x5973, 0x5B32)}
#: Names that are words or months too; alone they are taken for a known name only beside another one.
AMBIGUOUS = frozenset("April Art August Bill Brown Chance Christian Dawn Faith Frank Grace Grant Green Hope Joy June King Lang Long Mark May Pat Price Rose Sterling Sue Summer Will Young".split())
CJK_SURNAMES, CJK_GIVEN = "王李张刘陈杨赵黄周吴", {"m": "伟强军磊勇杰涛明", "f": "芳娜敏静丽艳娟霞"}


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    """Check digits of an account number: the whole, with the country behind it and letters from 10 on, is 1 modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the e-mail addresses: from each ``@`` over one run to the left and a domain to the right, in linear time."""
    at, floor = -1, 0
    for part in text.split("@")[:-1]:
        start, at = at + 1, at + 1 + len(part)
        run = text[max(floor, start + len(part.rstrip(_LOCAL))) : at]
        local = run[run.rfind("..") + 2 if ".." in run else 0 :].lstrip(".")
        if local and local[-1] != "." and (domain := _DOMAIN.match(text, at + 1)):
            yield at - len(local), domain.end()
            floor = domain.end()


def _bare(name: str) -> str:
    """A name without a genitive's ending."""
    return name[:-2] if name[-2:] in ("'s", "’s") else name.rstrip("'’-")


def names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names after a form of address, and the places where one of these names stands alone.

    Standing alone is by spelling only, so another person or thing of that name is taken for the same; names that are
    words as well (``AMBIGUOUS``) count only directly before or after another known name.
    """
    known: dict[str, tuple[str, str]] = {}
    for m in _NAME.finditer(text):
        gender, given = TITLES[m[1]], m[3] and 2
        for group in (2, 3) if given else (2,):
            kind, name = f"name-{gender if group == given else 's'}", _bare(m[group])
            known.setdefault(name, (kind, name.lower()))
            yield m.start(group), m.start(group) + len(name), kind, name.lower()
    alone = [(m, m[0] if m[0] in known else _bare(m[0])) for m in _WORD.finditer(text)] if known else []
    for k, (m, name) in enumerate(alone):
        if name in known:
            if name in AMBIGUOUS:
                beside = [(alone[k - 1][0], m)] * (k > 0 and alone[k - 1][1] in known) + [(m, alone[k + 1][0])] * (k + 1 < len(alone) and alone[k + 1][1] in known)
                if not any(text[a.end() : b.start()] == " " for a, b in beside):
                    continue
            yield m.start(), m.start() + len(name), *known[name]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a text, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(a, b, "email", text[a:b].lower()) for a, b in emails(text)]
    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if "AKIA" in text or "ghp_" in text or "sk-" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _PREFIXED.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in _NUMBERS:
            found += [(m.start(), m.end(), kind, m[0] if kind == "ip" else re.sub(r"[^0-9A-Z+]", "", m[0])) for m in pattern.finditer(text)]
    if any(t in text for t in TITLES):
        found += names(text)
    if "先生" in text or "女士" in text or "小姐" in text:
        for m in _CJK_NAME.finditer(text):
            found.append((m.start(1), m.end(2), f"cjk-{'m' if m[3] == '先生' else 'f'}", m[1] + m[2]))
    out: list[tuple[int, int, str, str]] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key

    def _number(self, tweak: str, *values: int) -> int:
        return int.from_bytes(hashlib.blake2b("|".join([tweak, *map(hex, values)]).encode(), key=self.key, digest_size=16).digest())

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size): Feistel rounds over a rectangle, walked until inside."""
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            x, y = divmod(value, b)
            for r in range(4):
                x = (x + self._number(tweak, size, 2 * r, y)) % a
                y = (y + self._number(tweak, size, 2 * r + 1, x)) % b
            value = x * b + y
            if value < size:
                return value

    def shaped(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Another string of the same form: digits for digits, letters for letters of the same case, other signs kept.

        With ``hexadecimal`` a text of 16 or more digits and letters a to f, one letter at least, becomes another such number.
        A long string is permuted block by block, each block under the digest of those before it: different strings stay different.
        """
        hexa = hexadecimal and len(text) >= 16 and not re.search("[^0-9a-f]", text) and bool(re.search("[a-f]", text))
        sets = ["0123456789abcdef"] * len(text) if hexa else ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in text]
        out, before = [], hashlib.blake2b(key=self.key, digest_size=16)
        for at in range(0, len(text), SHAPED_BLOCK):
            block = text[at : at + SHAPED_BLOCK]
            out.append(self._shaped_block(block, sets[at : at + SHAPED_BLOCK], f"{tweak}|{before.hexdigest()}" if at else tweak))
            before.update(block.encode())
        return "".join(out)

    def _shaped_block(self, text: str, sets: list[str], tweak: str) -> str:
        value, size, form = 0, 1, "".join(s[:1] if len(s) > 1 else f"={s}" for s in sets)
        for c, s in zip(text, sets, strict=True):
            value, size = value * len(s) + s.index(c), size * len(s)
        value, out = self.permute(value, size, f"{tweak}|{form}"), []
        for s in reversed(sets):
            value, k = divmod(value, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    def surrogate(self, kind: str, value: str, attempt: int = 0) -> str:
        """The canonical value that stands for ``value``; another one for each attempt."""
        tweak = f"{kind}|{attempt}"
        if kind == "email":
            local, domain = value.split("@")
            *labels, top = domain.split(".")
            return f"{self.shaped(local, tweak)}@{'.'.join(self.shaped(x, f'domain|{k - len(labels)}') for k, x in enumerate(labels))}.{top}"
        if kind == "ip":
            a, b, c, d = map(int, value.split("."))
            n = self.permute(((a * 256 + b) * 256 + c) * 256 + d, 256**4, tweak)
            return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            if luhn_digit(value[:-1]) == value[-1]:
                body = value[0] + self.shaped(value[1:-1], f"{tweak}|luhn")
                return body + luhn_digit(body)
            return value[0] + self.shaped(value[1:], tweak)
        if kind == "phone" and value[0] == "+":
            keep = max(2, len(value) - 10)  # the country code stays
            return value[:keep] + self.shaped(value[keep:], tweak)
        if kind == "iban":
            if value[2:4] == iban_check(value[:2], value[4:]):
                body = self.shaped(value[4:], f"{tweak}|{value[:2]}|check")
                return value[:2] + iban_check(value[:2], body) + body
            return value[:2] + self.shaped(value[2:], f"{tweak}|{value[:2]}")
        if kind.startswith("name-"):
            parts = NAME_PARTS["cyrillic" if "Ѐ" <= value[0] <= "ӿ" else "latin"][kind[5:]]
            n = self._number(tweak, *value.encode())
            middle = "" if kind != "name-s" and attempt < 4 else "".join(parts[0][(n >> (16 + 8 * k)) % len(parts[0])].lower() for k in range(1 + attempt // 4))
            return f"{parts[0][n % len(parts[0])]}{middle}{parts[1][(n >> 8) % len(parts[1])]}".lower()
        if kind.startswith("cjk-"):
            n = self._number(tweak, *value.encode())
            low, high = CJK_STRETCH[kind[4:]]
            given = CJK_GIVEN[kind[4:]] if attempt < 2 else [chr(c) for c in range(low, high)]
            return CJK_SURNAMES[n % 10] + "".join(given[(n >> (8 + 16 * k)) % len(given)] for k in range(len(value) - 1 + attempt // 16))
        return self.shaped(value, tweak, kind == "secret")

    def write(self, mention: str, kind: str, surrogate: str) -> str:
        """The surrogate in the mention's own case and punctuation."""
        if kind in ("ip", "secret") or kind.startswith("cjk-"):
            return surrogate
        if kind.startswith("name-"):
            return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate.capitalize()
        if kind == "email":
            return "".join(s.upper() if c.isupper() else s for c, s in zip(mention, surrogate, strict=True))
        signs = iter(surrogate)
        return "".join(next(signs) if c.isalnum() or c == "+" else c for c in mention)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, value): the distinct entities of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(i, *e) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for e in dict.fromkeys((k, v) for _, _, k, v in detect(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "kind", "value"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, kind string, value string")


def moved_entities(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, value, attempt) of the entities that don't keep their first surrogate.

    Each round groups the distinct entities by surrogate; of those that share one, all but the least value move on, and
    so does an entity that is its own surrogate. Rounds end when nothing moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for part in slices(batches):
            kinds, values, attempts = (part.column(k).to_pylist() for k in range(3))
            new = [make.surrogate(k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    named = scratch.table(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)).mapInArrow(run, schema), "named")
    while True:
        least = named.groupBy("kind", "surrogate").agg(F.min("value").alias("least"), F.count("*").alias("n")).filter("n > 1 or least = surrogate")
        least = scratch.table(least, "least")
        if least.isEmpty():
            return named.filter("attempt > 0").select("kind", "value", "attempt")
        judged = named.join(least, ["kind", "surrogate"], "left").withColumn("moves", F.expr("n is not null and (value <> least or value = surrogate)"))
        named = scratch.table(judged.select("kind", "value", F.expr("attempt + cast(moves as int)").cast("int").alias("attempt")).mapInArrow(run, schema), "named")


def replace(text: str, make: Surrogates, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    out, spans, at = [], [], 0
    for start, end, kind, value in detect(text):
        new = make.write(text[start:end], kind, make.surrogate(kind, value, attempts.get((kind, value), 0)))
        out += [text[at:start], new]
        spans.append({"kind": kind, "start": start, "n_chars": end - start, "surrogate": new})
        at = end
    return "".join([*out, text[at:]]) if spans else text, spans


def _moved(spark: SparkSession, docs: DataFrame, key: bytes, id_col: str, text_col: str, moved_rows: int):
    """What a map over ``docs`` needs to know of moved entities: a broadcast, or a column of each row's own."""
    scratch = Scratch(spark)
    found = scratch.table(entities(docs, id_col, text_col), "entities")
    moved = moved_entities(found, key, scratch)
    few = moved.limit(moved_rows + 1).collect()
    if len(few) <= moved_rows:
        scratch.drop("entities", "named", "least")
        return spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in few}), None
    own = found.join(moved, ["kind", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("moved"))
    return None, own


def _attempts(column: list | None, shared, n: int) -> list[dict]:
    if shared is not None:
        return [shared.value] * n
    return [{(m["kind"], m["value"]): m["attempt"] for m in row or []} for row in column]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("n_chars", pa.int32()), ("surrogate", pa.string())]))


def surrogate_texts(spark: SparkSession, docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", moved_rows: int = MOVED_ROWS) -> DataFrame:
    """(doc_id, text, n_entities, kinds, spans) for every row of ``docs``; ``spans`` are places in the old text.

    Two passes over the texts: one gathers the distinct entities for the check, one replaces. Texts are not shuffled,
    unless more than ``moved_rows`` entities have to leave their first surrogate. Null texts stay null; equal rows get
    equal texts.
    """
    shared, own = _moved(spark, docs, key, id_col, text_col, moved_rows)
    texts = keyed_text(docs, id_col, text_col)
    if own is not None:
        texts = texts.join(own.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "text", "moved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for part in slices(batches):
            attempts = _attempts(part.column(2).to_pylist() if shared is None else None, shared, part.num_rows)
            new = [(None, []) if t is None else replace(t, make, a) for t, a in zip(part.column(1).to_pylist(), attempts, strict=True)]
            spans = [s for _, s in new]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t for t, _ in new], pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(sorted({x["kind"] for x in s})) for s in spans], pa.string()), pa.array(spans, SPANS)],
                names=["doc_id", "text", "n_entities", "kinds", "spans"],
            )

    return texts.mapInArrow(run, "doc_id long, text string, n_entities long, kinds string, spans array<struct<kind: string, start: int, n_chars: int, surrogate: string>>")


def surrogate_documents(spark: SparkSession, docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", moved_rows: int = MOVED_ROWS) -> DataFrame:
    """``docs`` with its columns, the texts replaced as ``surrogate_texts`` does."""
    shared, own = _moved(spark, docs, key, id_col, text_col, moved_rows)
    names, at, schema = docs.columns, docs.columns.index(text_col), docs.schema
    if own is not None:
        own_id, own_moved = fresh_names(docs.columns, "own_id", "moved")
        docs = docs.join(own.select(F.col("doc_id").alias(own_id), F.col("moved").alias(own_moved)), docs[id_col].cast("long").eqNullSafe(F.col(own_id)), "left").drop(own_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for part in slices(batches):
            attempts = _attempts(part.column(len(names)).to_pylist() if shared is None else None, shared, part.num_rows)
            new = [None if t is None else replace(t, make, a)[0] for t, a in zip(part.column(at).to_pylist(), attempts, strict=True)]
            columns = list(part.columns[: len(names)])
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).mapInArrow(run, schema)
