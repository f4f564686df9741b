"""URL filters: rules indexed by their rarest literal token.

A rule is a host and a path in one string (``example.com/en/``): it fits its host and
all subdomains if the path starts with the rule's.  A pattern is a regular expression
with the literal tokens that any match contains.  Each rule and pattern is filed under
the one of its tokens that the fewest URLs of the table hold; a URL's tokens fetch the
candidates, and only these run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hidden, shown

ALLOW, BLOCK = "allow", "block"
#: A literal token: letters, digits and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rules up to this number go to all executors; more are joined by Spark's choice.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a verdict."""

    verdict: str
    rule: str

    def regex(self) -> str:
        host, slash, path = self.rule.partition("/")
        return rf"(?s)\A(?:[^/]*\.)?\Q{host}\E" + (rf"\Q/{path}\E" if slash else r"(?=/|\z)")

    def tokens(self) -> list[str]:
        """The literal tokens that every fitting URL holds: all but an unfinished last one of the path."""
        host, _, path = self.rule.partition("/")
        return sorted({*tokens(host), *tokens(re.sub(rf"{TOKEN}\Z", "", path))})


@dataclass(frozen=True)
class Pattern:
    """A regular expression on host and path whose matches block, and a literal part of all matches."""

    regex: str
    literal: str


#: Host words of junk sites, with what may stand around them.
JUNK = ["casino", "adult", "pills", "bets", "spam", "ads"]
PATTERNS = [Pattern(rf"\A(?:[^/]*[.-])?{word}[.-]", word) for word in JUNK]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return (
        F.coalesce(ascii_lower(F.regexp_extract(url, shape, 1)), F.lit("")),
        F.coalesce(F.regexp_extract(url, shape, 2), F.lit("")),
    )


def tokens(text: str) -> list[str]:
    """The distinct literal tokens of a text."""
    return sorted(set(re.findall(TOKEN, text)))


def _token_column(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit(TOKEN), F.lit(0)))


def judge(urls: DataFrame, rules: Sequence[Rule], patterns: Sequence[Pattern] = PATTERNS, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting rule wins (of equally long ones the last by name) and gives rule and
    verdict.  Else ``rule`` is null and the verdict is block if any pattern matches,
    allow if none.  A null URL and one without ``://`` have empty host and path, which
    fit no rule with a host.  Columns of ``urls`` with these names give way; repeated
    rows are each judged; an empty table gives an empty one.
    """
    spark = urls.sparkSession
    added = ["host", "path", "rule", "verdict"]
    rest = [c for c in urls.columns if c not in added]
    host, path = host_and_path(F.col(url_col))
    parsed = hidden(urls, rest, host.alias("host"), path.alias("path")).withColumn("place", F.concat("host", "path"))
    kept = [c for c in parsed.columns if c.startswith("__kept")]

    filed = [(r.rule, r.verdict, len(r.rule), r.regex(), r.tokens()) for r in rules]
    filed += [(None, BLOCK, 0, p.regex, [p.literal]) for p in patterns]
    words = sorted({t for *_, own in filed for t in own})
    if not all(own for *_, own in filed):
        raise ValueError("every rule needs a literal token")
    spread: dict[str, int] = {}
    if words:
        held = parsed.select(F.explode(F.array_intersect(_token_column(F.col("place")), F.array(*map(F.lit, words)))).alias("t"))
        spread = {r["t"]: r["count"] for r in held.groupBy("t").count().collect()}  # rule words only
    index = [(min(own, key=lambda t: (spread.get(t, 0), -len(t), t)), *row) for *row, own in filed]
    index_df = spark.createDataFrame(index or [("", None, ALLOW, 0, "", )], "token string, r_rule string, r_verdict string, r_size int, r_regex string")
    if len(index) <= BROADCAST_RULES:
        index_df = F.broadcast(index_df)

    keys = sorted({t for t, *_ in index})
    wanted = F.array_intersect(_token_column(F.col("place")), F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>"))
    candidates = parsed.withColumn("row", F.monotonically_increasing_id()).withColumn("wanted", wanted)
    candidates = candidates.withColumn("token", F.explode_outer("wanted")).drop("wanted").join(index_df, "token", "left")
    fits = F.coalesce(F.rlike(F.col("place"), F.col("r_regex")), F.lit(False))
    best = F.max(F.when(fits & F.col("r_rule").isNotNull(), F.struct("r_size", "r_rule", "r_verdict")))
    blocked = F.bool_or(fits & F.col("r_rule").isNull())
    judged = candidates.groupBy("row").agg(*(F.first(c).alias(c) for c in [*kept, "host", "path"]), best.alias("best"), blocked.alias("blocked"))
    verdict = F.coalesce(F.col("best.r_verdict"), F.when(F.col("blocked"), BLOCK), F.lit(ALLOW))
    return judged.select(*shown(rest), "host", "path", F.col("best.r_rule").alias("rule"), verdict.alias("verdict"))
