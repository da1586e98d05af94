"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, and a shunting-yard parser
evaluates the and/or/with expressions that follow a tag.

Null and empty texts have no words, no places and no labels. Repeated rows give repeated results. One map over the
documents, no shuffle; a task holds one slice of texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zonalis.llm.common import WORD_TABLE, keyed_text, slices, utf8

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels; of phrases that start at one word the longest counts.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "general public license": "gpl",
    "gnu general public license": "gpl",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "affero general public license": "agpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
#: Tags that a licence expression follows, as they stand in lower-cased text.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Words before a notice phrase that make it a grant.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
#: The family of an identifier is its first part if that is listed here.
FAMILIES = ("agpl", "apache", "bsd", "epl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense", "zlib")
#: Whole identifiers of known licences, as patterns of what may follow their first part.
IDENTIFIERS = {
    "0bsd": "", "afl": r"-[123]\.[0-2]", "agpl": r"-[13]\.0(?:\+|-only|-or-later)?", "apache": r"(?:-[12]\.[01]\+?)?", "artistic": r"-[12]\.0(?:-perl|-cl8)?", "blueoak": r"-1\.0\.0", "bsd": r"(?:-[0-4]-clause(?:-[a-z-]+)?|-protection|-source-code)?",
    "bsl": r"-1\.[01]", "busl": r"-1\.1", "cc": r"-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.[05](?:-[a-z]+)?", "cc0": r"(?:-1\.0)?", "cddl": r"-1\.[01]", "cpl": r"-1\.0", "curl": "", "ecl": r"-[12]\.0", "epl": r"(?:-[12]\.0)?", "eupl": r"-1\.[0-2]",
    "gfdl": r"-1\.[1-3](?:-(?:no-)?invariants)?(?:\+|-only|-or-later)?", "gpl": r"(?:-[1-3]\.0)?(?:\+|-only|-or-later)?", "ijg": "", "isc": "", "json": "", "lgpl": r"(?:-[23]\.[01])?(?:\+|-only|-or-later)?", "licenseref": r"-[a-z0-9.-]+", "lppl": r"-1\.[0-3][ac]?",
    "mit": r"(?:-0|-advertising|-cmu|-enna|-feh|-modern-variant|-open-group)?", "mpl": r"(?:-[12]\.[01])?(?:-no-copyleft-exception)?", "ms": r"-(?:pl|rl|lpl)", "ncsa": "", "none": "", "ofl": r"-1\.[01](?:-(?:no-)?rfn)?", "openssl": "", "osl": r"-[123]\.[01]", "php": r"-3\.0[1]?",
    "postgresql": "", "psf": r"-2\.0", "python": r"-2\.0(?:\.1)?", "ruby": "", "sspl": r"-1\.0", "unicode": r"-(?:3\.0|dfs-201[56]|tou)", "unlicense": "", "upl": r"-1\.0", "vim": "", "w3c": r"(?:-[0-9]+)?", "wtfpl": "", "x11": "", "zlib": r"(?:-acknowledgement)?", "zpl": r"-[12]\.[01]",
}
#: What an operand that is no known licence counts as; no policy allows it.
UNKNOWN = "unknown"
#: Identifiers that the default policy accepts.
PERMISSIVE = frozenset({"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "public-domain", "unlicense", "zlib"})

_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Shunting-yard: the licence expression at the start of ``text`` in postfix order; None if there is none.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``. Operands are identifiers, any exception after ``with``, and identifiers of no known
    licence too, so that nothing that an ``and`` demands is lost; a plain word without digit or hyphen that is no known licence is prose. Outside
    parentheses the expression ends where no operator follows an operand, at an operand that a full stop or colon closes,
    and before an operator that prose follows; inside them prose makes it no expression.
    """
    out: list[str] = []
    ops: list[str] = []
    at, operand, depth = 0, True, 0
    while m := _TOKEN.match(text, at):
        word = m[1]
        if operand:
            if word == "(":
                ops.append(word)
                depth += 1
            elif word == ")" or word in _RANK:
                return None
            else:
                name = word.rstrip(".:")
                if not (known(name) or re.search("[0-9-]", name) or ops and ops[-1] == "with"):
                    if not ops or depth:
                        return None
                    ops.pop()
                    operand = False
                    break
                out.append(name)
                operand = False
                if name != word and not depth:
                    break
        elif word in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = True
        elif word == ")" and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        else:
            break
        at = m.end()
    if operand or depth:
        return None
    return out + ops[::-1]


_KNOWN = re.compile("|".join(rf"{re.escape(k)}{v}" for k, v in IDENTIFIERS.items()))


def known(identifier: str) -> bool:
    """Whether the whole identifier is that of a known licence; a document may stand before a reference."""
    return bool(_KNOWN.fullmatch(identifier.rsplit(":", 1)[-1] if "licenseref" in identifier else identifier))


def family(identifier: str) -> str:
    if not known(identifier):
        return UNKNOWN
    if identifier.startswith("cc-by"):
        return re.sub(r"-\d.*$", "", identifier)
    first = identifier.split("-")[0].rstrip("+")
    return first if first in FAMILIES or first in ("bsl", "cc0") else identifier


def evaluate(postfix: list[str], allowed: frozenset[str]) -> tuple[bool, list[str], str]:
    """Whether ``allowed`` satisfies the expression, the families of its licences, and the expression written out.

    An operand that is no known licence is never satisfied. Parts are written once, at the end, so long expressions take linear time.
    """
    allowed = allowed - {UNKNOWN}
    stack: list[tuple[bool, object]] = []
    families: dict[str, None] = {}
    for k, word in enumerate(postfix):
        if word not in _RANK:
            kind = family(word)
            if postfix[k + 1 : k + 2] != ["with"]:  # an exception is no licence
                families[kind] = None
            stack.append((kind in allowed, word))
            continue
        b, a = stack.pop(), stack.pop()
        if word == "with":  # an exception only adds permissions
            stack.append((a[0], (a[1], " with ", b[1])))
        else:
            stack.append((a[0] and b[0] if word == "and" else a[0] or b[0], ("(", a[1], f" {word} ", b[1], ")")))
    ok, tree = stack[0]
    out, todo = [], [tree]
    while todo:
        part = todo.pop()
        if isinstance(part, tuple):
            todo.extend(reversed(part))
        else:
            out.append(part)
    return ok, list(families), "".join(out)


def _automaton(words) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


class Scanner:
    """The automata are built once per worker."""

    def __init__(self, allowed: frozenset[str] = PERMISSIVE):
        self.allowed = allowed
        spaced = {f" {p} ": p for p in NOTICE_PHRASES}
        self.phrases = ahocorasick.Automaton()
        for key, phrase in spaced.items():
            self.phrases.add_word(key, phrase)
        self.phrases.make_automaton()
        self.tags = _automaton(TAGS)

    def scan(self, text: bytes | None) -> tuple:
        lowered = (text or b"").lower()
        words = lowered.translate(WORD_TABLE).split()
        line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte: the phrases are ASCII
        base: list[tuple[int, str]] = []
        notices: dict[int, str] = {}
        for end, phrase in self.phrases.iter(line):
            start = end - len(phrase) - 1
            if phrase in BASE_PHRASES:
                base.append((start, BASE_PHRASES[phrase]))
            if len(phrase) > len(notices.get(start, "")):
                notices[start] = phrase
        score, labels = 0.0, {x for _, x in base}
        for start, phrase in notices.items():
            labels.add(NOTICE_PHRASES[phrase])
            before = line[max(0, start - 40) : start + 1]
            score = max(score, 0.9 if any(g in before for g in GRANTS) else 0.6)
        expression = permitted = None
        if b"license" in lowered:
            plain = lowered.decode("utf-8", "replace")
            for end, _ in self.tags.iter(plain):
                stop = plain.find("\n", end)
                postfix = parse_expression(plain[end + 1 : stop if stop >= 0 else len(plain)])
                if postfix:
                    ok, families, written = evaluate(postfix, self.allowed)
                    labels.update(families)
                    score = 1.0
                    if expression is None:
                        expression, permitted = written, ok
                    permitted = permitted and ok
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32) if base else None
        at = np.searchsorted(blanks, [p for p, _ in base]).tolist() if base else []  # words before a place
        return (
            len(words),
            len(base),
            min(at, default=None),
            max(at, default=None),
            ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)),
            score,
            expression,
            permitted,
        )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permitted boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row per row of ``docs``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are of the base phrases, ``labels`` of all phrases and
    expressions (``unknown`` for an operand that is no known licence). ``score`` is 1 with a valid expression after a tag, 0.9 with a phrase after words of a grant, 0.6 with
    a bare phrase, else 0. ``expression`` is the first one found, ``permitted`` whether ``allowed`` satisfies all of
    them (null without any).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allowed)
        for part in slices(batches):
            rows = [scanner.scan(t) for t in utf8(part, "text")]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
