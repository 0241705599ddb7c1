"""Stand-in inputs over the given tables: one text each, which Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone.operators.ranks import global_position

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_track_pt": """select user_id as track_id, event_id, ts,
       row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
       -3.0e0 + (user_id % 50) * 0.1e0 + ((event_id * 131) % 1000) / 100000.0e0 as lon,
       51.0e0 + (user_id % 30) * 0.1e0 + ((event_id * 197) % 1000) / 100000.0e0 as lat,
       case when event_type = 'error' then null else value end as ele
from events""",
    "fx_node": """select p_partkey as node_id,
       -3.0e0 + ((p_partkey * 7919) % 10000) / 10000.0e0 as lon,
       51.0e0 + ((p_partkey * 104729) % 10000) / 10000.0e0 as lat
from part""",
    "fx_way_node": """select l_orderkey as way_id,
       row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos,
       l_partkey as node_id
from lineitem""",
    "fx_net_node": """select l_orderkey as way_id,
       row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos,
       cast(floor(l_orderkey / 10) as bigint) * 20 + l_partkey % 20 as node_id
from lineitem""",
    "fx_way": """select o_orderkey as way_id,
       case o_orderpriority when '1-URGENT' then 'primary' when '2-HIGH' then 'residential'
            when '3-MEDIUM' then 'construction' when '4-NOT SPECIFIED' then 'footway' else 'proposed' end as highway,
       case o_orderstatus when 'F' then 'secondary' when 'O' then '' else 'newkind' end as construction,
       case when o_orderkey % 11 = 0 then 'tram' else null end as railway,
       case when o_orderkey % 121 = 0 then 'yes' else null end as disused
from orders""",
    "fx_rel_member": """select conv_id as relation_id, turn as pos, (conv_id * 31 + turn) % 2000 as way_id,
       case role when 'system' then 'platform' when 'assistant' then 'backward' else '' end as role
from conversations""",
    "fx_schedule": """select o_custkey as uid, o_orderkey as src_line, cast(o_orderdate as date) as runs_from,
       cast(o_orderdate as date) + interval '180' day as runs_to,
       case when o_orderkey % 10 = 0 then 'C' when o_orderkey % 10 in (1, 2) then 'O' when o_orderkey % 10 = 3 then 'N' else 'P' end as stp,
       o_orderstatus as train_status, o_orderpriority as category
from orders""",
    "fx_change": """select o_custkey as k, o_orderkey as seq,
       case when o_orderstatus = 'F' then 'N' when o_orderstatus = 'O' then 'R' else 'D' end as op, o_totalprice as payload
from orders""",
    "fx_station": """select p_partkey as station_id, p_name as name, p_size * 100.0e0 as easting, p_retailprice as northing
from part where p_partkey % 3 = 0""",
    "fx_authority": """select p_partkey as code, upper(p_name) || ' Railway Station' as name, p_size * 100.0e0 + 15.0e0 as easting, p_retailprice + 5.0e0 as northing
from part where p_partkey % 3 = 1""",
    "fx_candidate": """select p_partkey as id, p_type as kind, p_size as priority, p_retailprice as distance_m,
       ((p_partkey * 37) % 1000) / 1000.0e0 as route_axis
from part""",
    "fx_stroke": """select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as stroke_id,
       l_returnflag as layer, l_linestatus as pen, l_quantity as length_mm, l_orderkey as source_ref
from lineitem""",
    "fx_elevation": """select d.doc_id as feature_id, cast(d.n_chars as double) as global_ele,
       case when l.quality = 1 then cast(d.n_chars as double) + 10.0e0 else null end as native_ele, d.source as source_id
from documents d left join labels l on d.doc_id = l.doc_id""",
    "fx_tagged": """select o_orderkey as way_id,
       case when o_orderkey % 3 = 0 then case o_orderkey % 29 when 0 then 'motorway_link' when 1 then 'service' when 2 then 'pedestrian' when 3 then 'track' when 4 then 'bus_stop'
            when 5 then 'Tertiary' when 6 then 'newroad' when 7 then 'yes' when 8 then 'razed' when 9 then 'cycleway' when 10 then 'construction' when 11 then 'living_street'
            when 12 then 'busway' when 13 then 'secondary' when 14 then 'footway' else 'residential' end end as highway,
       case o_orderkey % 4 when 0 then 'secondary' when 1 then 'newkind' end as construction,
       case o_orderkey % 7 when 0 then 'tram' when 1 then 'miniature' when 2 then 'siding' end as railway,
       case when o_orderkey % 35 = 0 then 'yes' when o_orderkey % 35 = 1 then 'no' end as abandoned,
       case when o_orderkey % 21 = 0 then 'tram' when o_orderkey % 21 = 1 then 'rail' end as razed_railway,
       case o_orderkey % 19 when 0 then 'water' when 1 then 'coastline' when 2 then 'wood' when 3 then 'peak' end as nature,
       case o_orderkey % 17 when 0 then 'river' when 1 then 'riverbank' when 2 then 'weir' end as waterway,
       case o_orderkey % 23 when 0 then 'forest' when 1 then 'reservoir' when 2 then 'retail' end as landuse,
       case o_orderkey % 31 when 0 then 'park' when 1 then 'stadium' end as leisure,
       case o_orderkey % 5 when 0 then 'yes' when 1 then 'no' when 2 then 'cathedral' when 3 then 'university' end as building,
       case o_orderkey % 11 when 0 then 'castle' when 1 then 'monument' end as historic,
       case o_orderkey % 13 when 0 then 'library' when 1 then 'hospital' when 2 then 'place_of_worship' end as amenity,
       case when o_orderkey % 2 = 0 then 'Name ' || o_orderkey end as name,
       case when o_orderkey % 37 = 0 then 'administrative' end as boundary,
       case o_orderkey % 6 when 0 then '2' when 1 then '4;5' when 2 then 'many' when 3 then '7' end as lanes,
       case o_orderkey % 9 when 0 then '13,5 m' when 1 then '70''' when 2 then '6' when 3 then 'wide' end as width,
       case o_orderkey % 8 when 0 then 'yes' when 1 then 'no' end as bridge,
       case o_orderkey % 10 when 0 then 'yes' when 1 then 'culvert' when 2 then 'no' end as tunnel,
       case o_orderkey % 12 when 0 then 'yes' end as covered,
       case o_orderkey % 15 when 0 then 'underground' end as location,
       case o_orderkey % 14 when 0 then 'private' when 1 then 'permissive' end as access,
       case o_orderkey % 16 when 0 then 'alley' when 1 then 'driveway' end as service,
       case o_orderkey % 18 when 0 then '1' when 1 then '-1.50' when 2 then '0.0' when 3 then '0;1' when 4 then ' 2 ' end as level,
       o_totalprice / 100000.0e0 as area_mm2, o_totalprice / 50000.0e0 as length_mm
from orders""",
}


class Inputs:
    """The tables of one folder, and the stand-ins over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "fx_stroke":
            return self.strokes()
        for table in TABLES:
            if table in VIEWS[name].replace(",", " ").split() or f"{table};" in VIEWS[name]:
                self(table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name])

    def plain_strokes(self) -> DataFrame:
        """The rows of the view fx_stroke without stroke_id, which costs an exchange of all rows, for queries that don't use it."""
        lines = self("lineitem")
        return lines.select(F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("pen"), F.col("l_quantity").alias("length_mm"), F.col("l_orderkey").alias("source_ref"))

    def strokes(self) -> DataFrame:
        """The rows of the view fx_stroke, numbered without its window over all rows in one task."""
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        lines = self("lineitem").select(*order, "l_returnflag", "l_linestatus")
        placed = global_position(lines, order, "stroke_id")
        return placed.select("stroke_id", F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("pen"), F.col("l_quantity").alias("length_mm"), F.col("l_orderkey").alias("source_ref"))


def with_views(sql: str) -> str:
    """sql with the stand-ins that it names put before it."""
    used = [f"{n} as ({t})" for n, t in VIEWS.items() if n in sql]
    if not used:
        return sql
    own = sql.strip()
    start, recursive = ("with recursive ", "recursive ") if own.lower().startswith("with recursive ") else ("with ", "")
    return f"with {recursive}{', '.join(used)}, {own[len(start):]}" if own.lower().startswith("with ") else f"with {', '.join(used)} {own}"
