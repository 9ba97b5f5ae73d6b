"""URL filter: pattern rules indexed by their rarest literal token.

``filter_urls`` judges every row of a table by a set of rules.  A rule has a regular
expression, which is tried on ``host + path`` of the URL, and a literal text that each
URL it fits contains token by token.  Rules are indexed under that token of the literal
which the fewest URLs of the table hold; a URL's tokens fetch its candidate rules from the
index and only these run their expression.  A rule without a usable token is kept under
the empty token, which every URL has, so it is tried on all of them.

Only DataFrame expressions are used.  URLs are judged once per distinct text.  The
verdicts go back to the rows by a join on the URL; a URL that holds over
``HOT_SHARE`` of all rows (there are fewer than ``1 / HOT_SHARE`` of those, which bounds the
broadcast) is joined by broadcast, so no task gathers a hot URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, literal_table, materialise

#: A URL that holds a larger share of all rows is joined by broadcast.
HOT_SHARE = 0.001
#: What separates the tokens of hosts, paths and literals.
TOKEN_BREAK = r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]+"
VERDICTS = ("allow", "block")
RULE_COLUMNS = "name string, verdict string, pattern string, literal string"
INDEX_COLUMNS = "name string, verdict string, pattern string, token string"


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java regular expression, found in host + path.  ``literal``: text whose
    whole tokens occur in every URL that the pattern fits.  The rule with the longest
    ``name`` wins; of equally long ones the smallest name, block before allow."""

    name: str
    verdict: str
    pattern: str
    literal: str


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that begin with ``path``.

    A path that does not end at a token break may continue inside a token, so its last
    token is not part of the literal."""
    if verdict not in VERDICTS:
        raise ValueError(f"verdict must be one of {VERDICTS}: {verdict!r}")
    whole = re.sub(r"[0-9A-Za-z_\x80-\U0010ffff]+$", "", path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?\Q{host}\E(?=/|$)\Q{path}\E", f"{host}/{whole}")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct tokens of a text, the empty one always among them."""
    return F.array_union(F.array(F.lit("")), F.split(text, TOKEN_BREAK))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the literal token that the fewest rows of ``urls`` hold
    (equally rare: the smallest), or the empty token."""
    own = rules.withColumn("token", F.explode(tokens("literal")))
    wanted = own.select("token").where("token <> ''").distinct()
    held = (urls.select(F.explode(tokens(F.concat("host", "path"))).alias("token"))
            .join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("held")))
    # the empty token is the last choice
    rated = own.join(held, "token", "left").withColumn(
        "cost", F.when(F.col("token") == "", F.lit(2**62)).otherwise(F.coalesce("held", F.lit(0))))
    return (rated.groupBy("name", "verdict", "pattern")
            .agg(F.min_by("token", F.struct("cost", "token")).alias("token")))


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns ``host``, ``path``, ``rule`` and ``verdict`` added.

    Columns of ``pages`` with these names are replaced.  A URL that no rule fits has a null
    rule and the verdict ``default``; a null URL, or one without ``://``, has an empty host
    and path and is judged as these.  Every row comes back, repeated ones too.  Without
    rules every verdict is ``default``.
    """
    spark = pages.sparkSession
    given = literal_table(spark, [(r.name, r.verdict, r.pattern, r.literal) for r in rules], RULE_COLUMNS)
    urls = materialise(pages.groupBy(F.col(url).alias("_url")).agg(F.count("*").alias("_rows"))
                       .select("_url", "_rows", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")))
    # as long as the list of rules that the caller holds, so it may pass through the driver
    index = literal_table(spark, [tuple(r) for r in rule_index(urls, given).collect()], INDEX_COLUMNS)
    best = (urls.select("_url", F.concat("host", "path").alias("_text"))
            .withColumn("token", F.explode(tokens(F.col("_text"))))
            .join(index, "token")
            .where(F.expr("_text RLIKE pattern"))
            .groupBy(F.col("_url").alias("_judged"))
            .agg(F.min(F.struct(-F.length("name"), "name", F.col("verdict") != "block", "verdict")).alias("_best")))
    judged = materialise(
        urls.join(best, F.col("_url") == F.col("_judged"), "left")
        .select("_url", "_rows", "host", "path", F.col("_best.name").alias("rule"),
                F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
    rows = pages.drop("host", "path", "rule", "verdict")
    total = judged.agg(F.sum("_rows")).first()[0] or 0
    is_hot = (F.col("_rows") > HOT_SHARE * total) | F.col("_url").isNull()
    hot, rest = judged.where(is_hot).drop("_rows"), judged.where(~is_hot).drop("_rows")
    same = rows[url].eqNullSafe(hot["_url"])
    few = rows.join(F.broadcast(hot), same)
    many = rows.join(F.broadcast(hot.select("_url")), same, "left_anti").join(rest, rows[url] == rest["_url"])
    return few.unionByName(many).drop("_url")
