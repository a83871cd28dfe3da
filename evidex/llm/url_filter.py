"""URL verdicts by rules and lists, whose membership a cascade of Bloom filters decides exactly.

Level 0 of a cascade encodes the listed keys, level 1 the keys of the corpus that level 0 takes for
listed though they are not, level 2 the listed keys that level 1 takes for those, and so on until a level
has no false positive. The universe is every key that occurs in the corpus, so for each of them the
first level that misses it decides, without a join and without doubt.

Everything is DataFrame expressions. The levels are literals of the plan: their size follows the listed keys
that occur in the corpus, which are counted, and never the corpus; the keys are made distinct before they are
shuffled, so a host that a third of all urls share is one key a task. A list is a parameter, a sequence or a
DataFrame; of one with more than ``MAX_LISTED`` keys that occur, membership is decided by joins of distinct
hosts instead, which is as exact.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict
of an unlisted key; repeated rows give repeated results; an empty table gives an empty table; other
columns are not read. Of rules of equal length, none can fit the same url twice.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, release

MAX_LISTED = 1_000_000
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Domains that are blocked where no rule fits.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ? or #; A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def suffixes(host: Column, most: int) -> Column:
    """The host and the domains above it that have at most ``most`` labels; nothing for an empty host."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    some = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(host != "", some).otherwise(F.array().cast("array<string>"))


def rule_keys(host: Column, path: Column, rules=RULES) -> Column:
    """Every host suffix with every start of the path that is as long as some rule's."""
    lengths = sorted({len(p) for _, _, p in rules})
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]), lambda x: x.isNotNull())
    most = max(h.count(".") + 1 for _, h, _ in rules)
    return F.flatten(F.transform(suffixes(host, most), lambda h: F.transform(starts, lambda p: F.concat(h, p))))


class Beyond(ValueError):
    """A list of more keys than a plan takes."""


@dataclass
class Cascade:
    """Levels of (bits, hashes, words of 64 bits)."""

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)

    def _in(self, key: Column, level: int) -> Column:
        bits, hashes, words = self.levels[level]
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folds to one literal, which a transform() would not
        met = F.lit(True)
        for at in _places(key, level, bits, hashes):
            met = met & (F.getbit(F.get(table, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return met

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._in(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(f"{level}.{i}"), key), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, n: int, level: int, miss: float) -> tuple[int, int, list[int]]:
    hashes = max(1, round(-math.log2(miss)))
    bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("at"))
    words = set_bits.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("x"))
    table = [0] * (bits // 64)
    for r in words.collect():  # as many as the list's bits need
        table[r["w"]] = r["x"]
    return bits, hashes, table


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade of ``listed`` (key, distinct) over ``universe`` (key, distinct); listed keys that do not occur there are left out."""
    out = Cascade()
    own, others = keep(listed.join(universe, "key", "left_semi"), "listed-keys"), universe.join(listed, "key", "left_anti")
    n = own.count()
    if n > MAX_LISTED:
        release(own)
        raise Beyond(f"{n} listed keys; a cascade of the plan takes {MAX_LISTED}")
    miss = min(0.5, n / max(1, universe.count() - n))
    kept = [own]
    while n:
        level = len(out.levels)
        out.levels.append(_level(own, n, level, miss))
        # what a level takes wrongly is all that the next one is built of, and all it is asked of but the keys of this one
        own, others = keep(others.filter(out._in(F.col("key"), level)), "taken-keys"), own
        kept.append(own)
        n, miss = own.count(), 0.5
    for x in kept:
        release(x)
    return out


def keys_of(spark: SparkSession, keys) -> DataFrame:
    """A list of keys, a sequence or a DataFrame of one column, as distinct rows (key)."""
    if isinstance(keys, DataFrame):
        return keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key <> ''").distinct()
    one = F.split(F.lit("\n".join(sorted(set(keys)))), "\n")  # one literal, however many keys
    return spark.range(1).select(F.explode(one).alias("key")).filter("key <> ''")


def judge(df: DataFrame, url_col: str = "url", id_col: str = "page_id", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. ``blocked``: a sequence or a DataFrame of hosts."""
    spark = df.sparkSession
    parts = df.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = keys_of(spark, blocked)
    most = max([b.count(".") + 1 for b in blocked], default=1) if not isinstance(blocked, DataFrame) else hosts.agg(F.max(F.size(F.split("key", "\\.")))).first()[0] or 1
    of_rules, of_hosts = rule_keys(F.col("host"), F.col("path"), rules), suffixes(F.col("host"), most)
    # a key of the list has no slash, a key of a rule has one
    universe = keep(parts.select(F.explode(F.concat(of_rules, of_hosts)).alias("key")).distinct(), "url-keys")
    names = {h + p: verdict for verdict, h, p in rules}
    own = keys_of(spark, names)
    # one cascade decides both: it has keys with a slash from the rules only, and keys without one from the list only
    try:
        cascade, in_plan = build(universe, own.unionByName(hosts)), True
    except Beyond:
        cascade, in_plan = build(universe.filter(F.contains("key", F.lit("/"))), own), False
    release(universe)
    fit = F.filter(of_rules, cascade.contains)
    longest = F.element_at(F.array_sort(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), -1)["k"]
    rule = F.when(F.size(fit) > 0, longest)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = parts.withColumn("rule", rule)
    if in_plan:
        out = out.withColumn("listed", F.exists(of_hosts, cascade.contains))
    else:
        pairs = parts.select("host").distinct().select("host", F.explode(suffixes(F.col("host"), most)).alias("key"))
        # kept, so that both sides of the last join are plain exchanges and a hot host's rows can be split
        met = keep(pairs.join(hosts, "key", "left_semi").select("host", F.lit(True).alias("listed")).distinct(), "url-listed")
        out = out.join(met, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(known, F.col("rule"))).when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
