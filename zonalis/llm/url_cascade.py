"""URL filters by cascades of Bloom filters: exact membership of listed keys, tested in a projection, without a join.

A key is a host or a domain above it, followed by the start of a path: ``example.net/en/``. The keys that the urls of the corpus
can ask for (their universe) are known before any is judged, so the errors of a filter are known too: the first level encodes the
listed keys, the second the keys of the universe that pass the first and aren't listed, the third the listed keys that pass
the second, and so on until no key passes that shouldn't. A key is listed if the number of levels that it passes, up to the
first that it fails, is odd.

All is DataFrame work: bits are put together by group-by and ``bit_or``, one array a level; a query reads these arrays as scalar
subqueries. Only keys that pass the first level are ever grouped, and the first level is made so strict that these are
about as many as the listed ones, so the arrays grow with the list and the logarithm of the universe. Lists of more than
``BLOCK_KEYS`` keys are cut by hash into blocks, each with a cascade of its own, and urls are judged block after block.
"""

from __future__ import annotations

from itertools import count
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import Scratch

#: Listed keys of a block: bounds the arrays of a cascade to some MB, whatever the length of the list.
BLOCK_KEYS = 1_000_000
#: Bits of a level, at least and at most (2 MB an array).
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 24
#: Share of the keys that a level after the first lets through wrongly.
LATER_RATE = 0.25
#: Numbers for the scratch tables of a session: no two have one tag.
_tags = count()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    parts = [F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return F.translate(parts[0], UPPER, LOWER), parts[1]


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> list[Column]:
    """All keys that could be listed for a url: its last so many labels, then its path's first so many characters; or null.

    Only the label counts and path lengths that the list has are asked for, so a host of very many labels gives few keys.
    """
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return [F.when((dots >= k - 1) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k in labels for n in lengths]


class Level:
    """One Bloom filter: ``bits`` (a power of two) and ``hashes`` positions of a key, seeded by the level's number."""

    def __init__(self, number: int, keys: int, rate: float):
        want = max(1.0, keys * -log(rate) / log(2) ** 2)
        self.number, self.bits = number, min(MOST_BITS, max(LEAST_BITS, 1 << ceil(log2(want))))
        # where the bound on bits leaves fewer for a key, fewer places are best
        self.hashes = max(1, min(24, round(-log2(rate)), round(self.bits / max(1, keys) * log(2))))
        self.words = None

    def places(self, key: Column) -> list[Column]:
        h = F.xxhash64(F.lit(self.number), key)
        return [F.xxhash64(h, F.lit(k)).bitwiseAND(F.lit(self.bits - 1)) for k in range(self.hashes)]

    def encode(self, spark: SparkSession, keys: DataFrame, scratch: Scratch) -> Level:
        """Reads the keys and writes the filter's words, one row."""
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        mask = F.expr("shiftleft(1L, cast(p & 63 as int))")
        words = place.select(F.shiftright("p", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        blank = spark.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        dense = words.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words"))
        self.words = scratch.table(row, f"level-{next(_tags)}")
        return self

    def passes(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        words, out = self.words.scalar(), None
        for p in self.places(key):
            one = F.call_function("shiftright", F.get(words, F.shiftright(p, 6)), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            out = one if out is None else out & one
        return out


class Cascade:
    """Levels over one block of a list; no levels if nothing is listed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was made for."""
        out = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[at].passes(key), out).otherwise(F.lit(at % 2 == 1))
        return out


def fit_cascade(spark: SparkSession, universe: DataFrame, listed: DataFrame, scratch: Scratch) -> Cascade:
    """A cascade of ``listed`` (key, distinct, no nulls) that is exact on ``universe`` (key; repeats do no harm)."""
    size = listed.count()
    if not size:
        return Cascade([])
    others = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels = [Level(1, size, min(0.5, max(1e-7, size / (2 * others)))).encode(spark, listed, scratch)]
    passed = universe.filter(levels[0].passes(F.col("key"))).select("key", F.lit(False).alias("listed"))
    known = passed.unionByName(listed.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    left = scratch.table(known, f"left-{next(_tags)}")
    while True:
        inside = len(levels) % 2 == 0
        wrong = left.filter(F.col("listed") == F.lit(inside)).select("key")
        size = wrong.count()
        if not size:
            return Cascade(levels)
        level = Level(len(levels) + 1, size, LATER_RATE).encode(spark, wrong, scratch)
        levels.append(level)
        left = scratch.table(left.filter((F.col("listed") == F.lit(inside)) | level.passes(F.col("key"))), f"left-{next(_tags)}")


class Listed:
    """A list of keys, cut into blocks by hash, with the label counts and path lengths that it has."""

    def __init__(self, spark: SparkSession, urls: DataFrame, listed: DataFrame, scratch: Scratch, block_keys: int = BLOCK_KEYS):
        keys = scratch.table(listed.filter(F.col("key").isNotNull()).select("key").distinct(), f"listed-{next(_tags)}")
        shape = keys.select(F.substring_index("key", "/", 1).alias("host"), "key").select(
            F.size(F.split("host", r"\.")).alias("labels"), (F.length("key") - F.length("host")).alias("length")
        )
        found = shape.agg(F.count("*"), F.collect_set("labels"), F.collect_set("length")).first()
        self.labels, self.lengths = sorted(found[1]), sorted(found[2])
        self.blocks = max(1, -(-found[0] // block_keys))
        if found[0]:
            asked = urls.select(F.explode(F.array(*self.candidates())).alias("key")).filter("key is not null")
        self.cascades = []
        for b in range(self.blocks if found[0] else 0):
            mine = self.block(F.col("key")) == b
            self.cascades.append(fit_cascade(spark, asked.filter(mine), keys.filter(mine), scratch))

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(self.blocks))

    def candidates(self) -> list[Column]:
        return candidate_keys(F.col("host"), F.col("path"), self.labels, self.lengths)

    def longest(self, rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
        """Adds the longest listed key of (host, path) of each row, null if there is none; one pass a block."""
        rows = rows.withColumn(name, F.lit(None).cast("string"))
        for b, cascade in enumerate(self.cascades):
            keys = {f"_key{k}": c for k, c in enumerate(self.candidates())}
            fits = [F.when((self.block(F.col(k)) == b) & cascade.has(F.col(k)), F.struct(F.length(k).alias("size"), F.col(k).alias("key"))) for k in keys]
            old = F.when(F.col(name).isNotNull(), F.struct(F.length(name).alias("size"), F.col(name).alias("key")))
            rows = rows.withColumns(keys).withColumn(name, F.greatest(*fits, old)["key"]).drop(*keys)
            if self.blocks > 1:
                rows = scratch.table(rows, f"{name}-{next(_tags)}")
        return rows


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): one row for each row of ``pages``.

    ``rules`` has (key, action) with action ``allow`` or ``block``, ``blocked`` has (key); a key holds a host, then a path from its first
    ``/`` on. A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, and of one key
    given with both actions, allow. Where no rule fits, ``rule`` is null and the url is blocked if a key of
    ``blocked`` fits (``listed``, the longest), else allowed.

    Null urls and urls without ``://`` have an empty host and path, fit nothing and are allowed; null keys are ignored;
    repeated rows are judged each; an empty ``pages`` gives no rows. Other columns are not read, so their names can't clash.
    """
    scratch = Scratch(spark)
    host, path = url_parts(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path")
    for name, keys in (("allow", rules.filter("action = 'allow'")), ("block", rules.filter("action = 'block'")), ("listed", blocked)):
        rows = Listed(spark, urls, keys, scratch, block_keys).longest(rows, name, scratch)
    rule = F.when(F.length("block") > F.coalesce(F.length("allow"), F.lit(-1)), F.col("block")).otherwise(F.col("allow"))
    verdict = F.when(rule.isNull(), F.when(F.col("listed").isNull(), "allow").otherwise("block")).when(rule == F.col("allow"), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words by which the registered query lists hosts: a label that has one of them, alone or between hyphens.
BLOCK_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(key, action) of rules."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(a).alias("action")) for k, a in rules))).alias("r")).select("r.*")


def hosts_by_words(pages: DataFrame, words: tuple[str, ...] = BLOCK_WORDS, url_col: str = "url") -> DataFrame:
    """(key) of the domains of all urls whose first label has one of ``words``, for whole sites (any path)."""
    host, _ = url_parts(pages[url_col].cast("string"))
    label = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?(?:\..*)?)$"
    return pages.select(F.regexp_extract(host, label, 1).alias("key")).filter("key <> ''").distinct()


_HOST = f"translate(regexp_extract(substr(u, instr(u, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_FITS = " ".join(f"WHEN ('.' || host LIKE '%.{k.split('/')[0]}' AND starts_with(path, '{k[k.index('/'):]}')) THEN '{k}'" for k, _ in sorted(RULES, key=lambda r: -len(r[0])))
ORACLE_SQL = f"""WITH parts AS (SELECT page_id, CASE WHEN instr(u, '://') > 0 THEN {_HOST} ELSE '' END AS host,
    CASE WHEN instr(u, '://') > 0 THEN regexp_extract(substr(u, instr(u, '://') + 3), '^([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
  ruled AS (SELECT *, CASE {_FITS} END AS rule, nullif(regexp_extract(host, '(?:^|\\.)((?:[^.]*-)?(?:{"|".join(BLOCK_WORDS)})(?:-[^.]*)?(?:\\..*)?)$', 1), '') AS bad FROM parts)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{k}' THEN '{a}'" for k, a in RULES)} WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, bad AS listed FROM ruled"""
