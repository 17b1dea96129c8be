"""Fixture views over the driver tables (see FIXTURES.md §3).

``titles_raw`` is the wide catalogue table the reference reads, encoded as
text from typed driver columns: one row per part, with sales facts from
lineitem.  It only supplies rows in the catalogue schema; all parsing and
aggregation happen in the library code that reads it.  The same view is
written in DuckDB SQL (``TITLES_RAW_SQL``) and the oracle additionally gets
``titles_truth``: the typed values the text encodes, so that the oracle
never parses text and a parser error shows as a mismatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, name: str, sf_dir: str,
                 build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written once per application as Parquet in the shared
    scratch folder, then scanned (column pruning, no recomputation)."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def titles_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``titles_raw`` as a written table: the catalogue "file" queries read."""
    return written_once(spark, "titles-raw", sf_dir, lambda: titles_raw(spark, sf_dir))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_sales"),
        F.avg("l_quantity").alias("avg_qty"),
        F.max("l_extendedprice").alias("max_price"),
        F.min("l_shipdate").alias("first_ship"),
    )


def titles_raw(spark: SparkSession, sf_dir: str, price_offset: float = 0.0) -> DataFrame:
    """The wide catalogue table as text, one row per part (FIXTURES.md §3).

    ``price_offset`` is added to the numeric prices (the second snapshot of
    the merge fixture carries prices one higher).
    """
    part = table(spark, sf_dir, "part")
    j = part.join(_sales(spark, sf_dir), part.p_partkey == F.col("l_partkey"), "left")
    m = F.col("p_partkey")
    t, b = F.col("p_type"), F.col("p_brand")
    words = F.split(F.col("p_name"), " ")
    w1, w2 = F.element_at(words, 1), F.element_at(words, 2)
    q = F.lit("'")
    genres = (F.when(m % 11 == 0, F.lit(None).cast("string"))
              .when(m % 11 == 1, t)
              .when(m % 11 == 2, F.lit("[]"))
              .when(m % 11 == 3, F.concat(F.lit("("), q, t, q, F.lit(",)")))
              .otherwise(F.concat(F.lit("["), q, t, q, F.lit(", "), q, b, q, F.lit("]"))))
    tags = (F.when(m % 3 == 0, F.concat(F.lit("{"), q, w1, q, F.lit(": 5, "), q, w2, q,
                                        F.lit(": 3}")))
            .when(m % 3 == 1, F.concat(F.lit("["), q, w1, q, F.lit(", "), q, w2, q, F.lit(", "),
                                       q, w1, q, F.lit("]")))
            .otherwise(F.concat(w1, F.lit(", "), w2)))
    low = (F.col("p_size") * 1000).cast("bigint")
    high = low * 2

    def fmt(x):
        return F.when(m % 2 == 0, F.format_number(x, 0)).otherwise(x.cast("string"))

    dash = (F.when(m % 4 == 0, F.lit(" - ")).when(m % 4 == 1, F.lit("–"))
            .when(m % 4 == 2, F.lit(" — ")).otherwise(F.lit("−")))
    owners = (F.when(m % 13 == 0, F.lit(None).cast("string"))
              .when(m % 13 == 1, F.lit("unknown"))
              .when(m % 13 == 2, fmt(low))
              .otherwise(F.concat(fmt(low), dash, fmt(high))))
    release = (F.when(m % 17 == 0, F.lit("Oct 21, 2008"))
               .otherwise(F.date_format(F.col("first_ship"), "yyyy-MM-dd")))
    price = (F.when(m % 19 == 0, F.lit("NaN")).when(m % 19 == 1, F.lit("1d"))
             .otherwise((F.col("p_retailprice") + F.lit(price_offset)).cast("string")))
    desc = F.concat(F.col("p_name"), F.lit("\nby \""), b, F.lit("\", size "),
                    F.col("p_size").cast("string"))
    return j.select(
        m.cast("bigint").alias("appid"),
        F.col("p_name").alias("name"),
        release.alias("release_date"),
        price.alias("price"),
        genres.alias("genres"),
        tags.alias("tags"),
        owners.alias("estimated_owners"),
        F.coalesce(F.col("n_sales"), F.lit(0)).cast("bigint").alias("positive"),
        F.col("avg_qty").alias("average_playtime_forever"),
        F.col("max_price").alias("peak_ccu"),
        desc.alias("short_description"),
    )


# Column order of the catalogue fixture (and of snapshot A).
TITLE_COLUMNS = ["appid", "name", "release_date", "price", "genres", "tags", "estimated_owners",
                 "positive", "average_playtime_forever", "peak_ccu", "short_description"]

# ---------------------------------------------------------------------------
# DuckDB side: the same text view and the typed truth it encodes.
# ---------------------------------------------------------------------------
_TITLES_CTE = r"""
sales AS (
  SELECT l_partkey, count(*) AS n_sales, avg(l_quantity) AS avg_qty,
         max(l_extendedprice) AS max_price, min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_partkey
),
tj AS (
  SELECT p.*, s.n_sales, s.avg_qty, s.max_price, s.first_ship,
         split_part(p.p_name, ' ', 1) AS w1, split_part(p.p_name, ' ', 2) AS w2,
         CAST(p.p_size * 1000 AS BIGINT) AS lo, CAST(p.p_size * 2000 AS BIGINT) AS hi
  FROM part p LEFT JOIN sales s ON p.p_partkey = s.l_partkey
),
titles_raw AS (
  SELECT
    CAST(p_partkey AS BIGINT) AS appid,
    p_name AS name,
    CASE WHEN p_partkey % 17 = 0 THEN 'Oct 21, 2008'
         ELSE strftime(first_ship, '%Y-%m-%d') END AS release_date,
    CASE WHEN p_partkey % 19 = 0 THEN 'NaN' WHEN p_partkey % 19 = 1 THEN '1d'
         ELSE CAST(p_retailprice + __PRICE_OFFSET__ AS VARCHAR) END AS price,
    CASE WHEN p_partkey % 11 = 0 THEN NULL
         WHEN p_partkey % 11 = 1 THEN p_type
         WHEN p_partkey % 11 = 2 THEN '[]'
         WHEN p_partkey % 11 = 3 THEN '(''' || p_type || ''',)'
         ELSE '[''' || p_type || ''', ''' || p_brand || ''']' END AS genres,
    CASE WHEN p_partkey % 3 = 0 THEN '{''' || w1 || ''': 5, ''' || w2 || ''': 3}'
         WHEN p_partkey % 3 = 1 THEN '[''' || w1 || ''', ''' || w2 || ''', ''' || w1 || ''']'
         ELSE w1 || ', ' || w2 END AS tags,
    CASE WHEN p_partkey % 13 = 0 THEN NULL
         WHEN p_partkey % 13 = 1 THEN 'unknown'
         WHEN p_partkey % 13 = 2 THEN
           CASE WHEN p_partkey % 2 = 0 THEN format('{:,}', lo) ELSE CAST(lo AS VARCHAR) END
         ELSE
           (CASE WHEN p_partkey % 2 = 0 THEN format('{:,}', lo) ELSE CAST(lo AS VARCHAR) END)
           || (CASE p_partkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN chr(8211)
                                  WHEN 2 THEN ' ' || chr(8212) || ' ' ELSE chr(8722) END)
           || (CASE WHEN p_partkey % 2 = 0 THEN format('{:,}', hi) ELSE CAST(hi AS VARCHAR) END)
    END AS estimated_owners,
    CAST(coalesce(n_sales, 0) AS BIGINT) AS positive,
    avg_qty AS average_playtime_forever,
    max_price AS peak_ccu,
    p_name || chr(10) || 'by "' || p_brand || '", size ' || CAST(p_size AS VARCHAR)
      AS short_description
  FROM tj
),
titles_truth AS (
  SELECT
    CAST(p_partkey AS BIGINT) AS appid,
    p_name AS name,
    CASE WHEN p_partkey % 11 >= 4 THEN p_type END AS main_genre,
    CASE WHEN p_partkey % 11 >= 4 OR p_partkey % 11 = 3 THEN p_type END AS tuple_or_list_first,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(year(first_ship) AS INTEGER) END
      AS release_year,
    CASE WHEN p_partkey % 19 IN (0, 1) THEN NULL ELSE p_retailprice END AS price,
    CASE WHEN p_partkey % 13 IN (0, 1) THEN NULL ELSE CAST(lo AS DOUBLE) END AS owners_low,
    CASE WHEN p_partkey % 13 IN (0, 1) THEN NULL
         WHEN p_partkey % 13 = 2 THEN CAST(lo AS DOUBLE)
         ELSE CAST(hi AS DOUBLE) END AS owners_high,
    w1, w2,
    CAST(coalesce(n_sales, 0) AS BIGINT) AS positive,
    avg_qty AS average_playtime_forever,
    max_price AS peak_ccu
  FROM tj
)
"""


def titles_cte(price_offset: float = 0.0) -> str:
    """The DuckDB CTEs ``sales, tj, titles_raw, titles_truth``."""
    return _TITLES_CTE.strip().replace("__PRICE_OFFSET__", repr(float(price_offset)))


def with_titles(body: str, price_offset: float = 0.0) -> str:
    """Prefix an oracle query with the titles CTEs; ``body`` is either a
    SELECT or starts with ``, name AS (...)`` to add more CTEs."""
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return "WITH " + titles_cte(price_offset) + sep + body
