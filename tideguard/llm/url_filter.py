"""URL filters: prefix rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks that Spark's bit_or sums up from the list, so it is built where the list is (functions/bloom.py).
A URL looks one block up and tests eight bits in it. Those that pass are joined with the list itself, which removes false
positives; all others, nearly every row, are decided without a shuffle. The filter has 8 MB at most, so it is broadcast whatever
the list's length; beyond 4 million entries more URLs pass falsely, and the join removes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions import bloom
from tideguard.llm.common import quoted, salted_join, stored, table, without

# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Query parameters that say where a visitor came from, not what the page is.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
# Words of host names whose pages the query lists.
LISTED_HOSTS = ["spam", "pills", "casino", "bets", "adult", "ads"]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., m. or a default port; path without a last /, /index.html or .html; query parameters in order without
    those of TRACKING. No scheme and no fragment. Null for null and where there is no ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|\.html?|/)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.contains("://"), F.concat(host, path, query))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """value(rule) of the longest rule (host and path together) that fits; null if none does. Of equally long ones block wins."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    listed_url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add host, path, rule (host and path of the longest rule that fits) and verdict ('allow' or 'block') to every row.

    The verdict is the rule's; without one it is 'block' if the list has a URL of the same canonical form, else 'allow'. rules are
    (verdict, host, path) and part of the query's plan, so they are for policies of hundreds, and listed is for any number. A null
    URL, and one without ://, has an empty host and path, fits no rule with a path, and is never listed; such rows of the list
    count for nothing. Rows are neither merged nor dropped, so repeated rows and ids stay; an empty table gives an
    empty one and an empty list blocks nothing. Columns named as an output are replaced; others may have any name.
    """
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c in set(without(pages, made))]
    held = [f"c{i}" for i in range(len(keep))]
    entries = listed.select(canonical(quoted(listed_url)).alias("entry")).where("entry is not null").distinct()
    entries = stored(entries, "listed")
    blocks = bloom.blocks_for(entries.count())
    plain = pages.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], quoted(url).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = plain.withColumns({"host": host, "path": path})
    rows = rows.withColumns(
        {
            "rule": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]),
            "verdict": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[0]),
        }
    )
    rows = rows.withColumn("entry", F.when(F.col("verdict").isNull(), canonical(F.col("url")))).drop("url")
    tested = bloom.tested(rows, ["entry"], bloom.bloom_filter(entries, ["entry"], blocks), blocks, "passes")
    tested = tested.withColumn("entry", F.when(F.col("entry").isNotNull() & F.col("passes"), F.col("entry")))
    tested = stored(tested.select(*held, "host", "path", "rule", "verdict", "entry"), "judged")
    sure = tested.where("entry is null").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    possible = tested.where("entry is not null")
    counts = possible.groupBy("entry").agg(F.count("*").alias("n"))
    found = salted_join(possible, entries.withColumn("found", F.lit(True)), ["entry"], counts)
    found = found.withColumn("verdict", F.when(F.col("found"), F.lit("block")).otherwise(F.lit("allow")))
    columns = [*held, *made]
    both = sure.select(*columns).unionByName(found.select(*columns))
    return both.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *made)


def query(spark, sf_dir: str) -> DataFrame:
    """The list is made of the pages themselves, as no list is given: those on hosts with a word of LISTED_HOSTS in their name."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(host_of(F.col("url")).rlike(rf"(^|[.-])({'|'.join(LISTED_HOSTS)})([.-]|$)"))
    return judge_urls(pages, listed, keep=["page_id"])


ORACLE_SQL = r"""
with parts as (
  select page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
   list_sort(list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as params
  from pages),
 forms as (
  select page_id, host, path, case when contains(url, '://') then
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/index\.html?|\.html?|/)$', '')
    || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as entry
  from parts),
 listed as (select distinct entry from forms where regexp_matches(host, '(^|[.-])(spam|pills|casino|bets|adult|ads)([.-]|$)')),
 rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 fitting as (
  select page_id, arg_max(h || p, strlen(h || p)) as rule, arg_max(verdict, strlen(h || p)) as verdict
  from forms join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select f.page_id, f.host, f.path, r.rule, coalesce(r.verdict, case when l.entry is not null then 'block' else 'allow' end) as verdict
from forms f left join fitting r using (page_id) left join listed l on l.entry = f.entry
"""
