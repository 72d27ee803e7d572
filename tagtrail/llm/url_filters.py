"""URL rules and lists as cascades of Bloom filters: exact membership without joins.

Level 1 of a cascade holds the listed keys. Those keys of the corpus that are not listed
but pass level 1 go into level 2, the listed keys that pass level 2 into level 3, and so
on until no key passes wrongly. Since the levels are built over every key of the
corpus, the answer for each of these keys is exact: the first level that a key fails
tells. Building takes a few small jobs on distinct keys; asking is a bit test
per level inside the scan.

A level is a table of one row in the shared folder and enters a plan as a scalar
subquery. Its size is checked: ``MAX_KEYS`` listed keys at most (about 5 MB), else an error names
the count; a larger list is to be cut by a hash of its key into several cascades.
Only DataFrame functions are used.

Defined cases: null keys are never listed. An empty list has no level and lists nothing. A key
that is not of the corpus given at building may be reported wrongly with the chance of
a Bloom filter. A null url, or one without ``://``, has empty host and path and fits no rule.
Repeated rows are judged one by one; only the named columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.session import materialize

BITS_PER_KEY = 10
HASHES = 7
MAX_KEYS = 4_000_000
MAX_LENGTHS = 64
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table with one row of 64-bit words, and its number of bits."""

    words: DataFrame
    bits: int
    number: int

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * HASHES + i)), F.lit(self.bits)) for i in range(HASHES)]

    def passes(self, key: Column, words: Column) -> Column:
        result = F.lit(True)
        for place in self._places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            result = result & (F.getbit(word, (place % 64).cast("int")) == 1)
        return result

    @staticmethod
    def of(keys: DataFrame, count: int, number: int) -> Level:
        bits = -(-count * BITS_PER_KEY // 64) * 64
        empty = Level(keys, bits, number)
        places = keys.select(F.explode(F.array(*empty._places(F.col("key")))).alias("place"))
        bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
        words = places.select(F.shiftright("place", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
        full = words.unionByName(zero).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        row = full.agg(F.array_sort(F.collect_list(F.struct("word", "bit"))).alias("all")).select(F.col("all.bit").alias("words"))
        return Level(materialize(row, "level"), bits, number)


@dataclass(frozen=True)
class Cascade:
    """Alternate levels: odd ones hold listed keys, even ones keys that are not."""

    levels: tuple[Level, ...]

    def attached(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a column per level that holds its words; they are constants of the plan, not data."""
        return df.withColumns({f"{name}_{v.number}": v.words.scalar() for v in self.levels}) if self.levels else df

    def lists(self, key: Column, name: str) -> Column:
        """Whether a key of the corpus is listed, in a frame that :meth:`attached` gave."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            passes = self.levels[n].passes(key, F.col(f"{name}_{n + 1}"))
            answer = F.when(passes, answer).otherwise(F.lit(n % 2 == 1))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def build_cascade(listed: DataFrame, corpus: DataFrame) -> Cascade:
    """A cascade for the keys of ``listed`` that is exact on every key of ``corpus``; both have one column ``key``."""
    inside = materialize(listed.where("key IS NOT NULL").select("key").distinct(), "listed")
    outside = materialize(corpus.where("key IS NOT NULL").select("key").distinct().join(inside, "key", "left_anti"), "not-listed")
    levels: list[Level] = []
    put, other = inside, outside
    while count := put.count():
        if count > MAX_KEYS:
            raise ValueError(f"{count} keys are more than one cascade holds ({MAX_KEYS}); cut the list by a hash of the key")
        level = Level.of(put, count, len(levels) + 1)
        levels.append(level)
        asked = other.withColumn("words", level.words.scalar())
        put, other = materialize(asked.where(level.passes(F.col("key"), F.col("words"))).select("key"), "passing"), put
    return Cascade(tuple(levels))


def split_url(df: DataFrame, url_column: str) -> DataFrame:
    """Add ``host`` and ``path``."""
    url = F.col(url_column)
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return df.withColumns({
        "host": F.coalesce(F.translate(host, _UPPER, _SMALL), F.lit("")), "path": F.coalesce(path, F.lit("")),
    })


def _candidates(lengths: list[int]) -> Column:
    """Every key a rule for this url could have: host or parent domain, and a beginning of the path; longest first."""
    parts = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    starts = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths, reverse=True)]),
        lambda s: s.isNotNull(),
    )
    keys = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    return F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed_hosts: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules`` has columns action (allow or block), host and path: a rule fits its host
    and all subdomains where the path starts with the rule's; the longest wins, the one with the longer host of two equally long.
    A key that is both allowed and blocked is blocked. Without a rule the url is blocked if its
    whole host is one of ``listed_hosts`` (a column ``key``), else allowed.
    """
    rules = materialize(rules.select("action", F.concat("host", "path").alias("key"), F.length("path").alias("size")), "rules")
    lengths = [r[0] for r in rules.select("size").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have more than {MAX_LENGTHS} path lengths")
    named = split_url(pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")), "url")
    named = named.withColumn("candidates", _candidates(lengths))
    corpus = materialize(named.select(F.explode("candidates").alias("key")).distinct(), "url-keys")
    hosts = named.select(F.col("host").alias("key")).distinct()
    blocked = build_cascade(rules.where("action = 'block'").select("key"), corpus)
    allowed = build_cascade(rules.where("action = 'allow'").select("key"), corpus)
    listed = build_cascade(listed_hosts.select("key"), hosts)
    for cascade, name in ((blocked, "blocked"), (allowed, "allowed"), (listed, "listed")):
        named = cascade.attached(named, name)
    fitting = F.filter("candidates", lambda k: blocked.lists(k, "blocked") | allowed.lists(k, "allowed"))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(
        F.length(k).alias("size"), F.length(F.substring_index(k, "/", 1)).alias("host_size"), k.alias("key"))))
    found = named.withColumn("rule", longest["key"])
    verdict = F.when(F.col("rule").isNotNull(), blocked.lists(F.col("rule"), "blocked")).otherwise(
        listed.lists(F.col("host"), "listed")
    )
    return found.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.when(verdict, "block").otherwise("allow").alias("verdict")
    )
