"""Views over the test tables that stand for pictures, uploads, edits and contours (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

THUMBS = """
with p as (select vec_id as image_id, i, cast(embedding[i] as double) e0,
                  cast(embedding[(i+21)%64] as double) e1, cast(embedding[(i+42)%64] as double) e2
           from (select vec_id, embedding, explode(sequence(0,63)) as i from {embeddings}))
select image_id, cast(i % 8 as int) x, cast(floor(i/8) as int) y,
  cast(least(255,greatest(0,floor(128.5+1024*e0))) as int) r,
  cast(least(255,greatest(0,floor(128.5+1024*(0.75*e0+0.25*e1)))) as int) g,
  cast(least(255,greatest(0,floor(128.5+1024*(0.5*e0+0.5*e2)))) as int) b,
  case when (image_id*7+i*13)%11=0 then 0 else 255 end a
from p
"""
THUMBS_DUCK = THUMBS.replace("explode(sequence(0,63))", "unnest(range(0,64))").replace("embedding[i]", "embedding[i+1]").replace("embedding[(i+21)%64]", "embedding[(i+21)%64+1]").replace("embedding[(i+42)%64]", "embedding[(i+42)%64+1]").replace("{embeddings}", "embeddings")

_GRID = """
with q as (select KEY as image_id, l_quantity, l_extendedprice, l_discount, l_tax,
    row_number() over (partition by KEY order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 as idx,
    count(*) over (partition by KEY) as n
  from {lineitem})
select cast(image_id as bigint) image_id, cast(idx % W as int) x, cast(floor(idx/W) as int) y,
  cast(floor(l_quantity*5) as int) r, cast(floor(l_extendedprice)%256 as int) g,
  cast(floor(l_discount*100+0.5)*25 as int) b,
  case when floor(l_tax*100+0.5)=0 then 0 else 255 end a
from q where idx < floor(n/W)*W
"""
SWATCHES = _GRID.replace("KEY", "l_suppkey").replace("W", "24")
POSTERS = _GRID.replace("KEY", "year(l_shipdate)").replace("W", "256")
SWATCHES_DUCK, POSTERS_DUCK = (x.replace("{lineitem}", "lineitem") for x in (SWATCHES, POSTERS))

RINGS = """
with o as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey)-1 as seq,
             count(*) over (partition by o_custkey) as n from {orders}),
c as (select c_custkey, c_nationkey,
        row_number() over (partition by c_nationkey order by c_custkey) as rk
      from {customer} where c_custkey in (select o_custkey from o where n >= 8)),
v as (select cast(c_nationkey as bigint) doc_id, cast(c_custkey as bigint) contour_id, cast(seq as int) seq,
        (c_custkey*97)%1000 cx, (c_custkey*61)%1000 cy,
        (5 + cast(floor(o_totalprice) as bigint)%20) * (case when rk=1 then 12 else 1 end) as rad
      from o join c on c_custkey=o_custkey where n >= 8 and seq < 8)
select doc_id, contour_id, seq,
  cast(cx + rad*(case when seq in (0,1,7) then 1 when seq in (3,4,5) then -1 else 0 end) as double) x,
  cast(cy + rad*(case when seq in (1,2,3) then 1 when seq in (5,6,7) then -1 else 0 end) as double) y
from v
"""
RINGS_DUCK = RINGS.replace("{orders}", "orders").replace("{customer}", "customer")

_URLS = """
select doc_id as upload_id,
  concat('data:', case doc_id%3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'text/plain' end, ';base64,', CODE) as url
from {documents}
"""
URLS = _URLS.replace("CODE", "translate(base64(cast(text as binary)), concat(chr(13), chr(10)), '')")
URLS_DUCK = _URLS.replace("CODE", "base64(encode(text))").replace("{documents}", "documents")

EDITS = """
select user_id session_id, event_id, cast(ts as timestamp) ts,
  case event_type when 'click' then 'toggle' when 'view' then 'threshold'
                  when 'purchase' then 'color' when 'signup' then 'blur' else 'reset' end setting,
  cast(event_id % 4 as int) layer_id, cast(floor(value) as int) value
from {events}
"""
EDITS_DUCK = EDITS.replace("{events}", "events")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 pictures, one for each embedding."""
    return _view(spark, sf_dir, THUMBS, "embeddings")


def swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures 24 wide, one for each supplier."""
    return _view(spark, sf_dir, SWATCHES, "lineitem")


def posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven large pictures 256 wide."""
    return _view(spark, sf_dir, POSTERS, "lineitem")


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of octagons, one for each customer with eight orders; the first one of a nation is large."""
    return _view(spark, sf_dir, RINGS, "orders", "customer")


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, URLS, "documents")


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EDITS, "events")
