"""URL filter: rules first, then the verdict of a tree of path templates. DataFrame operations only.

Rules are pairs of a host and a path beginning; the longest that fits a url decides, and labels it. For the
rest a tree is grown for each host, a path segment a level, to the last segment:

- A segment of one url is variable and becomes `*`.
- One whose labelled share of blocked urls differs from the parent's (a chi-square test at `CHI`) stays as it
  is, however small its share of the host.
- The others are merged, as their labels don't tell them apart: into `*` those that fewer than one in `RARE` of
  the parent's urls have, into `~` the rest.
- After `DEPTH` segments a branch is grown while its labels disagree, level by level. Once they are all blocked,
  all allowed or none, no segment below could differ, and all below is one `/...`.
- A url's template is rejected if its labelled purity reaches a half: the share of blocked urls among the
  host's labelled urls of the template, smoothed with `WEIGHT` urls of the template's share over all hosts,
  itself smoothed towards the share of all labelled urls.

Urls are joined with segments of two urls or more by host, template and segment, so a host with very many urls
is spread over its segments; counts are aggregated with map-side combine before they are joined, and a hot
segment's join is split by the adaptive planner. The checking SQL makes every segment below one in RARE `*`
before it looks at labels, and all after DEPTH segments `/...`, so it agrees only where no such segment's labels
differ and no longer branch's labels disagree, as on the given pages.

Cases: host is what stands between the first `://` and the next `/`, `?`, `#`, A-Z lower-cased; path what
follows up to `?` or `#`; a null url or one without `://` has both empty, fits no rule, and gets the
method's verdict like any other. Without labelled urls the method allows (no share reaches a half). Repeated rows
count each. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octroi.session import written

DEPTH, RARE, CHI, WEIGHT = 3, 20, 3.84, 4.0


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def first_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; rules are (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    choose = lambda value: F.coalesce(*(F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in ordered), F.lit(None).cast("string"))
    return choose(lambda v, h, p: h + p), choose(lambda v, h, p: v)


def labelled_counts() -> list[Column]:
    known = F.col("label").isNotNull().cast("long")
    return [F.count("*").alias("n"), F.sum(known).alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]


def grown(rows: DataFrame, level: int) -> DataFrame:
    """`rows` with the template one segment longer."""
    here = rows.withColumn("segment", F.get("parts", F.lit(level)))
    children = here.where("segment is not null").groupBy("host", "template", "segment").agg(*labelled_counts())
    parents = children.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    share = (F.col("all_blocked") + 1.0) / (F.col("all_labelled") + 2.0)
    away = F.col("blocked") - F.col("labelled") * share
    differs = (F.col("labelled") > 0) & (away * away >= CHI * F.col("labelled") * share * (1.0 - share))
    kept = children.where("n > 1").join(parents, ["host", "template"]).where(differs | (F.col("n") * RARE >= F.col("all_n")))
    kept = kept.select("host", "template", "segment", F.when(differs, F.col("segment")).otherwise("~").alias("name"))
    named = here.join(kept, ["host", "template", "segment"], "left")
    longer = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*"))))
    return named.select("page_id", "host", "path", "rule", "label", "parts", longer.alias("template"))


def deepened(rows: DataFrame, level: int) -> DataFrame:
    """`rows`, which all have a segment at `level`, one segment longer where labels disagree, else ended by `...`; open: there is more."""
    labels = rows.where("label is not null").groupBy("host", "template").agg(F.count("*").alias("labelled"), F.sum("label").alias("blocked"))
    mixed = labels.where("blocked > 0 and blocked < labelled").select("host", "template", F.lit(True).alias("mixed"))
    marked = rows.join(mixed, ["host", "template"], "left")
    ended = marked.where("mixed is null").select(*rows.columns[:-1], F.concat("template", F.lit("/...")).alias("template"), F.lit(False).alias("open"))
    return grown(marked.where("mixed"), level).withColumn("open", F.size("parts") > level + 1).union(ended)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row of `pages` (page_id, url)."""
    rule, verdict = first_rule(rules)
    rows = located(pages).withColumns({"rule": rule, "label": F.when(verdict == "block", 1).when(verdict == "allow", 0).cast("long")})
    rows = rows.withColumns({"parts": F.split("path", "/"), "template": F.lit("")})
    for level in range(1, DEPTH + 1):
        rows = written(grown(rows, level), f"templates-{level}")
    rows, level = rows.withColumn("open", F.size("parts") > DEPTH + 1), DEPTH
    closed, more = rows.where("not open").drop("open"), rows.where("open").drop("open")
    while not more.isEmpty():
        level += 1
        rows = written(deepened(more, level), f"templates-{level}")
        closed, more = closed.union(rows.where("not open").drop("open")), rows.where("open").drop("open")
    rows = closed
    counts = rows.where("label is not null").groupBy("host", "template").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    counts = written(counts, "template-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (total.k + 1.0) / (total.n + 2.0) if total.n else 0.0
    wide = counts.groupBy("template").agg(((F.sum("k") + WEIGHT * overall) / (F.sum("n") + WEIGHT)).alias("prior"))
    prior = F.coalesce("prior", F.lit(overall))
    purity = (F.coalesce("k", F.lit(0)) + WEIGHT * prior) / (F.coalesce("n", F.lit(0)) + WEIGHT)
    # each template once: the verdict is looked up by urls, not worked out for each
    templates = rows.select("host", "template").distinct().join(counts, ["host", "template"], "left").join(wide, "template", "left")
    judged = templates.select("host", "template", F.when(purity >= 0.5, "block").otherwise("allow").alias("by_template"))
    by_rule = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow")
    return rows.join(judged, ["host", "template"]).select("page_id", "host", "path", "rule", F.coalesce(by_rule, "by_template").alias("verdict"), "template")


def checking_sql(rules: list[tuple[str, str, str]]) -> str:
    """The same filter as one statement."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {value(v, h, p)}" for v, h, p in ordered) + " END"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    levels = "".join(
        f""",
    h{d} AS MATERIALIZED (SELECT *, parts[{d + 1}] AS segment FROM t{d - 1}),
    c{d} AS (SELECT host, template, segment, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS blocked FROM h{d} WHERE segment IS NOT NULL GROUP BY ALL),
    p{d} AS (SELECT host, template, sum(n) AS all_n, (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS share FROM c{d} GROUP BY ALL),
    k{d} AS (
        SELECT host, template, segment,
            CASE WHEN labelled > 0 AND pow(blocked - labelled * share, 2) >= {CHI}::DOUBLE * labelled * share * (1 - share) THEN segment ELSE '~' END AS name
        FROM c{d} JOIN p{d} USING (host, template) WHERE n > 1 AND n * {RARE} >= all_n
    ),
    t{d} AS MATERIALIZED (
        SELECT page_id, host, path, rule, label, parts, CASE WHEN segment IS NULL THEN template ELSE template || '/' || coalesce(name, '*') END AS template
        FROM h{d} LEFT JOIN k{d} USING (host, template, segment)
    )"""
        for d in range(1, DEPTH + 1)
    )
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    l AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    t0 AS (SELECT *, {case(lambda v, h, p: f"'{h + p}'")} AS rule, {case(lambda v, h, p: int(v == "block"))} AS label, string_split(path, '/') AS parts, '' AS template FROM l){levels},
    f AS MATERIALIZED (SELECT page_id, host, path, rule, label, CASE WHEN len(parts) > {DEPTH + 1} THEN template || '/...' ELSE template END AS template FROM t{DEPTH}),
    n AS (SELECT host, template, count(*) AS n, sum(label) AS k FROM f WHERE label IS NOT NULL GROUP BY ALL),
    g AS (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE (sum(label) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) END AS overall FROM f WHERE label IS NOT NULL),
    w AS (SELECT template, (sum(k) + {WEIGHT}::DOUBLE * (SELECT overall FROM g)) / (sum(n) + {WEIGHT}::DOUBLE) AS prior FROM n GROUP BY template)
    SELECT page_id, host, path, rule,
        CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow'
            WHEN (coalesce(k, 0) + {WEIGHT}::DOUBLE * coalesce(prior, (SELECT overall FROM g))) / (coalesce(n, 0) + {WEIGHT}::DOUBLE) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict,
        template
    FROM f LEFT JOIN n USING (host, template) LEFT JOIN w USING (template)
    """
