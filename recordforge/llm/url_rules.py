"""URL filter: pattern rules fetched by their rarest literal token.

Every rule is a regular expression over `host + path` with the literal tokens
that any matching URL must hold as whole tokens. The index files a rule under
that one of its tokens which is rarest among the table's own URLs. A URL's
tokens fetch its candidate rules by an equi-join; only these run their regular
expressions. Host rules ("this host and its subdomains, paths that start so")
are compiled to such patterns too; of those that fit, the longest wins. Where
none fits, the patterns of rank 0 decide, such as keyword rules (a word of the
host, a segment of the path), and URLs that no rule touches pass. A verdict
depends on the URL and the rules alone, never on other rows.

Built-in functions and joins only; rules are a table of any size (action,
pattern, tokens, rule, rank), such as `host_rules` and `keyword_rules` make. Distinct
URLs are judged once, so a URL that fills a third of the table costs no more than
any other; so are tokens that a third of all URLs hold, as a rule is filed under
its rarest.

Defined cases: a null URL, or one without `://`, has an empty host and path and
passes; an empty path fits no host rule, as every rule's path begins with `/`;
repeated rows get equal verdicts; repeated rules count once; of rules that fit,
and of rules with one pattern, the greatest rank wins, then block, then the larger
pattern (or name); a rule without tokens is an error; no rules leave the default;
columns named host, path, rule or verdict are replaced, all others kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordforge.functions.names import free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Where a keyword counts: as a word of the host (but its last label), as a whole segment of the path.
PLACES = ((r"^[^/]*(^|[.-])", "[.-]"), (r"(?i)/", r"(/|\z)"))
RULES = "action string, pattern string, tokens array<string>, rule string, rank int"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.^$*+?()\[\]{}|\\])", r"\\$1")


def host_rules(rules: DataFrame) -> DataFrame:
    """Rules on hosts (action, host, path): the host and its subdomains, paths that start so.

    Tokens: those of the host, and those of the path that a delimiter ends.
    """
    tokens = F.concat(F.regexp_extract_all("host", F.lit("([a-z0-9]+)")), F.regexp_extract_all(F.lower("path"), F.lit("([a-z0-9]+)(?=[^a-z0-9])")))
    pattern = F.concat(F.lit(r"^([^/]*\.)?"), _escaped(F.col("host")), _escaped(F.col("path")))
    return rules.select("action", pattern.alias("pattern"), tokens.alias("tokens"), F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("rank"))


def keyword_rules(words: DataFrame) -> DataFrame:
    """Rules on keywords (action, word: a-z and 0-9, lower case): one for each of `PLACES`."""
    places = F.array(*[F.concat(F.lit(before), F.col("word"), F.lit(after)) for before, after in PLACES])
    return words.select("action", F.explode(places).alias("pattern"), F.array("word").alias("tokens"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("rank"))


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path; both empty without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url_col, PARTS, i), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    if bad := rules.filter("tokens is null or size(tokens) = 0").head():
        raise ValueError(f"rule without a literal token: {bad['pattern']}")
    blocks = F.col("action") == "block"
    table = rules.groupBy("pattern").agg(F.max(F.struct("rank", blocks.alias("blocks"), "rule", "action", "tokens")).alias("r")).select("pattern", "r.*")
    parsed = split_url(df.drop("host", "path", "rule", "verdict"), url_col)
    urls = parsed.select("host", "path").filter("host <> '' or path <> ''").distinct()
    full = F.concat("host", "path")
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.split(F.translate(full, UPPER, LOWER), "[^a-z0-9]+"))).alias("token"))
    wanted = table.select("pattern", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("pattern").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = wanted.join(seen, "token", "left").withColumn("k", F.row_number().over(rarest)).filter("k = 1").select("pattern", "token").join(table.drop("tokens"), "pattern")
    (won,) = free_names(parsed.columns, "_best")
    fits = tokens.join(index, "token").filter(F.expr("regexp_like(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct("rank", "blocks", "pattern")).alias(won))
    return parsed.join(best, ["host", "path"], "left").select(*[c for c in parsed.columns if c not in ("host", "path")], "host", "path", F.col(won)["rule"].alias("rule"), F.coalesce(F.col(won)["action"], F.lit(default)).alias("verdict"))
