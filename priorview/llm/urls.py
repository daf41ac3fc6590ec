"""URL filters: host and path rules, and a tree of path templates judged by labelled purity.
Built-in expressions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

# The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LEAST = 20            # a segment is literal from so many urls of its parent on
WEIGHT = 20           # labels that a prior is worth
BANDS = 10            # of purity; alike branches of a band are merged
REJECT_PCT = 50       # purity in percent from which a template is rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    plain = F.octet_length(host) == F.char_length(host)
    host = F.when(plain, F.lower(host)).otherwise(F.translate(host, ascii_uppercase, ascii_lowercase))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the
    url's path; null without one. Rules are a short list and become one CASE."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, rule).otherwise(out)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, n, labelled, bad) of distinct urls -> the same with their `template`.

    Level by level, a segment below the template so far stays literal if LEAST urls of that
    template have it, and becomes a wildcard otherwise, at any depth; the levels end where no
    segment has so many urls. A level is a partial aggregate and an equi-join back, written to
    the shared folder.
    """
    tree = urls.withColumns({"segs": F.when(F.col("path") == "", F.array().cast("array<string>"))
                             .otherwise(F.split(F.expr("substring(path, 2)"), "/", -1)), "template": F.lit("")})
    level = 0
    while True:
        tree = stored(tree.withColumn("seg", F.get("segs", F.lit(level))), "url-tree")
        kept = (tree.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("own"))
                .where(F.col("own") >= LEAST).select("host", "template", "seg", F.lit(True).alias("literal")))
        if kept.isEmpty():
            break
        tree = tree.join(kept, ["host", "template", "seg"], "left").withColumn(
            "template", F.when(F.col("seg").isNull(), F.col("template"))
            .when(F.col("literal"), F.concat("template", F.lit("/"), "seg")).otherwise(F.concat("template", F.lit("/*")))
        ).drop("seg", "literal")
        level += 1
    rest = F.greatest(F.lit(0), F.size("segs") - level)  # no deeper segment is literal
    return tree.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest))).drop("segs", "seg")


def purity(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + WEIGHT * prior) / (labelled + WEIGHT)


def rejected_templates(found: DataFrame) -> DataFrame:
    """(host, template, ...) of urls with templates -> (host, template, rejected).

    A template's purity is its share of bad labels, drawn towards its host's, which is drawn
    towards the whole table's. Branches of a host with as many segments, wildcards at the same
    places and a purity in the same band are merged, and judged by their pooled labels.
    """
    stats = stored(found.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")),
                   "url-templates")
    hosts = stats.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    total = hosts.agg(F.sum("host_bad"), F.sum("host_labelled")).first()
    overall = F.lit((total[0] or 0) / max(1, total[1] or 0))
    hosts = hosts.select("host", purity(F.col("host_bad"), F.col("host_labelled"), overall).alias("prior"))
    shape = F.regexp_replace("template", r"/(?!\*(/|$))[^/]*", "/x")
    own = stats.join(hosts, "host").withColumns({
        "shape": shape, "band": F.floor(purity(F.col("bad"), F.col("labelled"), F.col("prior")) * BANDS)})
    merged = own.groupBy("host", "shape", "band").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.first("prior").alias("p"))
    judged = merged.select("host", "shape", "band", (purity(F.col("b"), F.col("l"), F.col("p")) * 100 >= REJECT_PCT).alias("rejected"))
    return own.select("host", "template", "shape", "band").join(judged, ["host", "shape", "band"]).select("host", "template", "rejected")


def judged(pages: DataFrame, url_col: str = "url", bad_col: str | None = None,
           rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Every page with host, path, rule, template and verdict.

    The verdict is the rule's; without a rule it is `block` if the url's template is rejected by
    the labels, else `allow`. `bad_col` names a boolean label, null where there is none; without
    it, or without any label, no template is rejected. Null urls and those without `://` have an
    empty host and path. Rows count as often as they occur and all stay. Other columns pass
    through, and columns of the new names are replaced. An empty table gives no rows.

    Equal urls are one row of the tree with their counts; a frequent host is spread over its
    paths, and its rows meet the templates again in ordinary joins.
    """
    host, path = host_and_path(F.col(url_col))
    h, p, b = fresh(pages, "url_host", "url_path", "url_bad")
    bad = F.col(bad_col).cast("boolean") if bad_col else F.lit(None).cast("boolean")
    rows = pages.withColumns({h: host, p: path, b: bad})
    urls = rows.groupBy(F.col(h).alias("host"), F.col(p).alias("path")).agg(
        F.count("*").alias("n"), F.count(b).alias("labelled"), F.count_if(F.col(b)).alias("bad"))
    found = stored(templates(urls).select("host", "path", "template", "labelled", "bad"), "url-found")
    verdicts = found.join(rejected_templates(found), ["host", "template"])
    th, tp, t, r = fresh(rows, "tree_host", "tree_path", "tree_template", "tree_rejected")
    verdicts = verdicts.select(F.col("host").alias(th), F.col("path").alias(tp), F.col("template").alias(t), F.col("rejected").alias(r))
    out = rows.join(verdicts, (F.col(h) == F.col(th)) & (F.col(p) == F.col(tp)))
    rule = rule_for(F.col(h), F.col(p), rules)
    own = F.lit(None).cast("string")
    for name, verdict in rules:
        own = F.when(rule == name, verdict).otherwise(own)
    return out.withColumns({"host": F.col(h), "path": F.col(p), "rule": rule, "template": F.col(t),
                            "verdict": F.coalesce(own, F.when(F.col(r), "block").otherwise("allow"))}).drop(
        *(c for c in (h, p, b, th, tp, t, r) if c not in ("host", "path", "template")))


NUMBER = r"/([0-9]{1,18})(\.html)?/?$"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document that a url's last number names: bad if of low quality
    or toxic."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("number")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(x as bigint)")
    path = host_and_path(F.col("url"))[1]
    pages = pages.withColumn("x", F.regexp_extract(path, NUMBER, 1)).withColumn("number", number).drop("x")
    out = judged(pages.join(labels, "number", "left"), bad_col="bad")
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    def purity_sql(bad: str, labelled: str, prior: str) -> str:
        return f"(({bad}) + {WEIGHT} * ({prior})) / (({labelled}) + {WEIGHT})"

    fits = [f"WHEN (host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND "
            f"prefix(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))]
    return f"""
WITH RECURSIVE parsed AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), lab AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS is_bad FROM labels GROUP BY doc_id),
marked AS (SELECT p.*, l.is_bad FROM parts p LEFT JOIN lab l
           ON l.doc_id = try_cast(regexp_extract(p.path, '{NUMBER}', 1) AS BIGINT)),
t0 AS (SELECT host, path, count(*) AS n, count(is_bad) AS labelled, count(*) FILTER (WHERE is_bad) AS bad,
       CASE WHEN path = '' THEN [] ELSE string_split(path[2:], '/') END AS segs, '' AS template FROM marked GROUP BY host, path),
tree AS (
    SELECT 0 AS level, * FROM t0
    UNION ALL
    SELECT level + 1, host, path, n, labelled, bad, segs, template || '/' || CASE
           WHEN sum(n) OVER (PARTITION BY host, template, segs[level + 1]) >= {LEAST} THEN segs[level + 1] ELSE '*' END
    FROM tree WHERE len(segs) > level
),
found AS (SELECT * FROM tree WHERE level = len(segs)),
stats AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM found GROUP BY ALL),
total AS (SELECT sum(bad) / greatest(1, sum(labelled)) AS p FROM stats),
hosts AS (SELECT host, {purity_sql('sum(bad)', 'sum(labelled)', 'any_value(total.p)')} AS prior FROM stats, total GROUP BY host),
own AS (SELECT s.*, h.prior, floor({purity_sql('s.bad', 's.labelled', 'h.prior')} * {BANDS}) AS band,
        list_transform(string_split(template, '/'), lambda x: CASE WHEN x = '*' THEN x ELSE 'x' END) AS shape
        FROM stats s JOIN hosts h USING (host)),
merged AS (SELECT host, shape, band, {purity_sql('sum(bad)', 'sum(labelled)', 'any_value(prior)')} * 100 >= {REJECT_PCT} AS rejected
           FROM own GROUP BY host, shape, band),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)
SELECT r.page_id, r.host, r.path, r.rule, f.template,
       CASE {' '.join(f"WHEN r.rule = '{n}' THEN '{v}'" for n, v in RULES)} WHEN m.rejected THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN found f ON r.host = f.host AND r.path = f.path JOIN own o ON o.host = f.host AND o.template = f.template
JOIN merged m ON m.host = o.host AND m.shape = o.shape AND m.band = o.band
"""


OP2_SQL = _sql()
