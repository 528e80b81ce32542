"""URL filter: policy rules first, then a character language-model ratio, with built-in functions only.

Two variable-order Markov models (order ``ORDER``, Witten-Bell smoothing down to a uniform letter) are counted
from accepted and from rejected URLs. A URL's score is the log-likelihood difference (rejected minus accepted) of
its host and path, over its number of letters; the threshold is calibrated on URLs that were not counted.

The policy gives the labels: what a rule blocks is rejected, what one allows is accepted, and what none decides is judged by the
models. A fifth of the labelled URLs (by a hash of the URL) is held out for the threshold.

Letters are a-z, one digit class, ``. - /``, one class for anything else and two edges, so there are ``LETTERS`` ** 4
(about a million) four-letter strings: that bounds the table of log ratios, the one thing that is broadcast. Scheme, query and fragment are not
scored.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and is scored as the empty string;
repeated rows each get a row; very long URLs are scored whole; without rejected examples all that no rule decides
is allowed, without accepted ones what scores above 0 is blocked; columns beside page_id and url may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, materialize, pick, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
#: The models' letters, by number; ``_`` is any other.
ALPHABET = "_abcdefghijklmnopqrstuvwxyz0.-/^$"
LETTERS = len(ALPHABET)
#: Shares of held-out accepted URLs below, and of rejected ones above, which the threshold lies between.
ACCEPTED, REJECTED, ACCURACY = 0.995, 0.05, 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(url, "://", 1)
    rest = F.when(known, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def spelled(host: Column, path: Column) -> Column:
    """Host and path in the alphabet of the models, with edges."""
    folded = F.translate(ascii_lower(F.concat(host, path)), "123456789", "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(folded, r"[^a-z0./\-]", "_"), F.lit("$"))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    each = rows.select(*keep, "spell", F.explode(F.sequence(F.lit(1), F.length("spell") - ORDER)).alias("at"))
    return each.select(*keep, F.expr(f"substring(spell, at, {ORDER + 1})").alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """From (gram, accepted, rejected) counts: (gram, ratio), ratio = log P(last | before) of rejected minus accepted."""
    sides = ("accepted", "rejected")
    out = counts.withColumns({f"p_{c}": F.lit(1.0 / LETTERS) for c in sides})
    for k in range(ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - k, k + 1)
        lower = counts.groupBy(suffix.alias("s")).agg(*[F.sum(c).alias(f"{c}_w") for c in sides])
        seen = [F.sum(f"{c}_w").alias(f"{c}_n") for c in sides] + [F.sum((F.col(f"{c}_w") > 0).cast("int")).alias(f"{c}_t") for c in sides]
        if k:
            context = lower.groupBy(F.substring("s", 1, k).alias("c")).agg(*seen)
            both = lower.join(context, F.substring("s", 1, k) == F.col("c")).drop("c")
        else:  # one context, the empty one: four numbers
            both = lower.withColumns({n: F.lit(v or 0) for n, v in lower.agg(*seen).first().asDict().items()})
        out = out.join(both, suffix == F.col("s")).drop("s")
        for c in sides:
            n, t = F.col(f"{c}_n"), F.col(f"{c}_t")
            # Witten-Bell: as many new letters are expected as kinds were seen; nothing seen leaves the lower order.
            out = out.withColumn(f"p_{c}", F.when(n + t > 0, (F.col(f"{c}_w") + t * F.col(f"p_{c}")) / (n + t)).otherwise(F.col(f"p_{c}")))
        out = out.drop(*[f"{c}_{x}" for c in sides for x in "wnt"])
    return out.select("gram", (F.log("p_rejected") - F.log("p_accepted")).alias("ratio"))


def score(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """Replaces ``spell`` by ``score``, the mean log ratio over its letters. Rows are told apart by a number of their own.

    Ratios, at most ``LETTERS`` ** 4 of them, are broadcast. A row's letters are summed where the row is, so one short row of each URL is shuffled.
    """
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    keep = [c for c in numbered.columns if c != "spell"]
    joined = _grams(numbered, *keep).join(F.broadcast(ratios), "gram", "left")
    # Rounded, so that it does not depend on the order of the sum.
    return joined.groupBy(*keep).agg(F.round(F.avg(F.coalesce("ratio", F.lit(0.0))), 9).alias("score")).drop("row")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold."""
    rows = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), (F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0).alias("held"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "spell": spelled(F.col("host"), F.col("path"))})
    rows = rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))

    counted = lambda k: F.count(F.when((F.col("label") == k) & ~F.col("held"), 1))
    # Every gram of any URL has a row, so that every one gets a ratio, if only by its shorter ends.
    counts = _grams(rows.select("spell", "label", "held"), "label", "held").groupBy("gram").agg(counted(0).alias("accepted"), counted(1).alias("rejected"))
    ratios = materialize(log_ratios(materialize(counts, "url-grams")), "url-ratios")
    judged = materialize(score(rows, ratios), "url-scores")
    at = lambda k, share: F.percentile_approx(F.when(F.col("held") & (F.col("label") == k), F.col("score")), share, ACCURACY)
    low, high = judged.agg(at(0, ACCEPTED), at(1, REJECTED)).first()
    if high is None:
        threshold = float("inf")
    elif low is None:
        threshold = 0.0
    else:
        threshold = (low + high) / 2 if high > low else low
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op6_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _twin() -> str:
    """The same in SQL."""
    quoted = lambda x: "'" + x + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in RULES)
    steps, p = [], {c: f"1.0::DOUBLE / {LETTERS}" for c in "ar"}
    for k in range(ORDER + 1):
        before = f"o{k - 1}" if k else "(SELECT gram, " + ", ".join(f"{p[c]} AS p{c}" for c in "ar") + " FROM counts)"
        steps.append(f"""l{k} AS (SELECT right(gram, {k + 1}) AS s, sum(a) AS a, sum(r) AS r FROM counts GROUP BY ALL),
c{k} AS (SELECT left(s, {k}) AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM l{k} GROUP BY ALL),
o{k} AS (SELECT o.gram, CASE WHEN na + ta > 0 THEN (l.a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nr + tr > 0 THEN (l.r + tr * pr) / (nr + tr) ELSE pr END AS pr
  FROM {before} o JOIN l{k} l ON l.s = right(o.gram, {k + 1}) JOIN c{k} c ON c.c = left(l.s, {k}))""")
    share = lambda label, q: f"(SELECT min(score) FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM judged WHERE held AND label = {label}) WHERE i >= ceil({q} * n))"
    return f"""
WITH parts AS (SELECT row_number() OVER () AS id, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT s.*, (SELECT max_by(h || p, length(h || p)) FROM (VALUES {rules}) r(v, h, p) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM split s),
rows_ AS (SELECT u.*, (SELECT v FROM (VALUES {rules}) r(v, h, p) WHERE h || p = rule) AS decided, CAST('0x' || substr(md5(coalesce(url, '')), 1, 8) AS BIGINT) % 5 = 0 AS held,
  '{"^" * ORDER}' || regexp_replace(translate(translate(host || path, '{UPPER}', '{UPPER.lower()}'), '123456789', '000000000'), '[^a-z0./-]', '_', 'g') || '$' AS spell
  FROM ruled u),
marked AS (SELECT *, CASE decided WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label FROM rows_),
grams AS (SELECT id, label, held, substr(spell, i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(spell) - {ORDER} + 1)) AS i FROM marked)),
counts AS (SELECT gram, count(*) FILTER (WHERE label = 0 AND NOT held) AS a, count(*) FILTER (WHERE label = 1 AND NOT held) AS r FROM grams GROUP BY gram),
{", ".join(steps)},
judged AS (SELECT m.*, s.score FROM marked m JOIN (SELECT id, round(avg(ln(pr) - ln(pa)), 9) AS score FROM grams JOIN o{ORDER} USING (gram) GROUP BY id) s USING (id)),
bounds AS (SELECT {share(0, ACCEPTED)} AS low, {share(1, REJECTED)} AS high),
cut AS (SELECT CASE WHEN high IS NULL THEN 'infinity'::DOUBLE WHEN low IS NULL THEN 0.0 WHEN high > low THEN (low + high) / 2 ELSE low END AS t FROM bounds)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score > t THEN 'block' ELSE 'allow' END) AS verdict FROM judged, cut"""


ORACLE = _twin()
