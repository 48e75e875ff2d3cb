"""Boilerplate lines by site-relative frequency. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized, text_of

MAX_RATIO = 0.5
MIN_PAGES = 5
#: Tasks that the pages of one host are dealt to at most, where lines to drop are joined by shuffle.
SALTS = 64


def html_lines(html: str | Column) -> Column:
    """Visible text of a page, one line for each block element."""
    t = F.regexp_replace(text_of(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    u = text_of(url)
    host = F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    """Lines without surrounding blanks; blank ones do not count."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """id, host, n_lines, n_dropped and text without the lines that recur over their host.

    A line is dropped when more than max_ratio of its host's pages hold it and the host has at least min_pages pages.
    Pages without a host share the empty one. A line counts once a page however often it stands there, and is dropped
    wherever it stands. Null text has no lines; repeated rows are pages of their own; a null id stays null; other
    columns are not carried and may have any names; an empty table gives no rows; texts may be of any length.

    Pages are parsed once, into a written table of lines. Lines are counted as 128 bits of hash, by task before the
    shuffle. At most (lines a page) / max_ratio lines of a host can exceed the ratio, so what a host's pages look up is
    small however many pages it has; where all hosts' are too large to be sent to every task, pages are dealt by host
    and one of SALTS numbers, so that a large host is many tasks.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), lines_of(text).alias("_lines"))
    rows = materialize(rows, "lines")

    def code(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))

    total = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")).filter(F.col("_pages") >= min_pages)
    lines = rows.select("_host", F.explode(F.array_distinct("_lines")).alias("_line"))
    count = lines.groupBy("_host", code(F.col("_line")).alias("_code")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    often = count.join(total, "_host").filter(F.col("_n") > max_ratio * F.col("_pages")).groupBy("_host").agg(F.collect_list("_code").alias("_often"))
    often = materialize(often, "boilerplate")
    small = sized(often)
    if small is not often:
        kept = rows.join(small, "_host", "left")
    else:
        dealt = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_lines"), F.lit(SALTS)).cast("int")).join(dealt, ["_host", "_salt"], "left")
    keep = F.when(F.col("_often").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_often"), code(x))))
    out = kept.select("_id", "_host", F.size("_lines").cast("long").alias("n_lines"), keep.alias("_keep"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), "n_lines", (F.col("n_lines") - F.size("_keep")).alias("n_dropped"), F.array_join("_keep", "\n").alias("text"))


OP3_SQL = r"""
WITH a AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t
  FROM pages
), b AS (
  SELECT rid, page_id, host, list_filter(list_transform(string_split(
    replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&'),
    chr(10)), lambda x: regexp_replace(x, '^[\x20\t\r]+|[\x20\t\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM a
), hosts AS (SELECT host, count(*) AS n FROM b GROUP BY host),
l AS (SELECT rid, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM b),
often AS (
  SELECT l.host, l.line FROM l JOIN hosts ON l.host = hosts.host WHERE hosts.n >= 5
  GROUP BY l.host, l.line, hosts.n HAVING count(DISTINCT rid) > 0.5 * hosts.n AND count(DISTINCT rid) > 1
), k AS (
  SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.at) AS text, count(*) AS n FROM l
  WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.host = l.host AND o.line = l.line) GROUP BY l.rid
)
SELECT b.page_id, b.host, CAST(len(b.lines) AS BIGINT) AS n_lines, CAST(len(b.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text
FROM b LEFT JOIN k ON b.rid = k.rid
"""
