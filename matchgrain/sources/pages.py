"""Fields and table rows from raw web pages, as expressions over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(text: Column, *patterns: str) -> Column:
    """First pattern whose group 1 matches something, in order."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def strip_tags(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]+>", "\n"), r"[ \t\x0B\f]+", " ")


def extract_page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, `X vs Y` teams, date and referee of each page, patterns in priority order."""
    h = F.col(html)
    title = F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    text = strip_tags(h)
    date = F.coalesce(
        _first(h, r"""(?is)class=["'][^"']*(?:match-date|kickoff-time)[^"']*["'][^>]*>([^<]+)<""", r"""(?is)data-date=["']([^"']+)["']"""),
        F.nullif(F.substring_index(F.regexp_extract(h, r"""(?is)property=["']article:published_time["']\s+content=["']([^"']+)["']""", 1), "T", 1), F.lit("")),
    )
    referee = _first(
        h, r"""(?is)class=["'][^"']*(?:referee|match-official|officials)[^"']*["'][^>]*>([^<]+)<""",
    )
    said = _first(text, r"(?i)Referee:\s*([^\n\r]+)", r"(?i)Match Official:\s*([^\n\r]+)")
    return pages.select(
        *[c for c in pages.columns if c != html], title.alias("title"),
        F.nullif(F.trim(F.regexp_extract(title, r"(?i)^(.+?)\s+vs\s+(.+)$", 1)), F.lit("")).alias("home_team"),
        F.nullif(F.trim(F.regexp_extract(title, r"(?i)^(.+?)\s+vs\s+(.+)$", 2)), F.lit("")).alias("away_team"),
        date.alias("match_date"), F.coalesce(referee, said).alias("referee"),
    )


def extract_table_rows(pages: DataFrame, html: str = "html", header: str = "Referees", minimum_cells: int = 5) -> DataFrame:
    """Rows of the first table whose header holds `header`: (date, home, away, referee)."""
    tables = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table.*?</table>"), F.lit(0))
    wanted = F.get(F.filter(tables, lambda t: t.rlike(rf"(?is)<th[^>]*>\s*{header}\s*</th>")), F.lit(0))
    rows = F.regexp_extract_all(wanted, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    keep = [c for c in pages.columns if c != html]
    each = pages.select(*keep, F.posexplode(F.coalesce(rows, F.array().cast("array<string>"))).alias("row_no", "tr")).where("row_no > 0")
    cells = F.transform(
        F.regexp_extract_all(F.col("tr"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", ""))
    )
    out = each.withColumn("c", cells).where(F.size("c") >= minimum_cells)
    return out.select(*keep, "row_no", *[F.get("c", F.lit(i)).alias(n) for i, n in ((0, "match_date"), (1, "home_team"), (3, "away_team"), (4, "referee"))])
