"""The given test tables in the form the operators read.

Nulls and odd values are put in by arithmetic on the keys, so SQL can do the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomix.operators.coverage import observed_coverage
from fathomix.session import materialize

AS_OF = "2024-01-20 12:00:00"
ROOT_URL = "https://files.example.org/catalog.xml"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations, without a row number of their own."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        u.cast("string").alias("dataset_id"),
        "event_id",
        F.col("ts").alias("time"),
        F.when(e % 11 != 0, F.col("value")).alias("temperature"),
        F.get_json_object("props", "$.k").cast("double").alias("depth"),
        (F.lit(30.0) + (e % 700) / F.lit(100.0)).alias("salinity"),
        F.when(e % 13 != 0, (u * 37 % 1000) / F.lit(10.0) - 50.0 + (e % 97) / F.lit(100.0)).alias("lat"),
        F.when(e % 17 != 0, (u * 53 % 3000) / F.lit(10.0) - 150.0 + (e % 89) / F.lit(100.0)).alias("lon"),
        (e % 4).cast("double").alias("temperature_qc"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations in their arrival order."""
    return raw_observations(spark, sf_dir).withColumnRenamed("event_id", "row_idx")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every dataset, computed once and kept."""
    return materialize(observed_coverage(observations(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an index of datasets; the observed ones carry their coverage."""
    d = F.col("doc_id")

    def some(*pairs: tuple[int, str]):
        return F.array_compact(F.array(*(F.when(d % n == 0, F.lit(v)) for n, v in pairs)))

    url = F.concat(F.lit("https://data.example.org/"), d.cast("string"))
    documents = table(spark, sf_dir, "documents").select(
        F.when(d % 500 == 499, F.lit("allDatasets")).otherwise(d.cast("string")).alias("dataset_id"),
        F.concat_ws(" ", "source", "lang", F.lit("record"), d.cast("string")).alias("title"),
        (d % 997 * 10_000_000_000 + d).alias("rank"),
        F.col("text").alias("summary"),
        F.when(d % 17 != 0, F.concat(F.lit("_"), "source", F.lit("_"), "lang", F.lit("_lab ")))
        .otherwise(F.lit(" ")).alias("institution"),
        F.col("lang").alias("ioos_category"),
        F.when(d % 5 == 0, F.lit("Grid")).when(d % 5 < 3, F.lit("TrajectoryProfile"))
        .when(d % 5 == 3, F.lit("TimeSeries")).alias("cdm_data_type"),
        some((1, "depth"), (2, "sea_water_temperature"), (3, "sea_water_practical_salinity"),
             (5, "temperature_status_flag"), (7, "salinity_QARTOD_check")).alias("standard_names"),
        some((1, "time"), (2, "temperature"), (3, "salinity"), (4, "temperature_qc")).alias("variable_names"),
        F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("keywords"),
        F.when(d % 4 == 0, url).alias("griddap"),
        F.when(d % 3 == 0, url).alias("tabledap"),
        F.when(d % 101 == 7, F.lit("")).alias("wms"),
    )
    ranges = observations(spark, sf_dir).groupBy("dataset_id").agg(
        *(f(c).alias(f"{c}_{n}") for c in ("time", "lat", "lon") for n, f in (("min", F.min), ("max", F.max)))
    )
    return documents.join(ranges, "dataset_id", "left")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as described datasets: global attributes and those of four variables."""
    k = F.col("p_partkey")
    text = k.cast("string")
    day = F.lpad((k % 9 + 1).cast("string"), 2, "0")
    rows = [
        ("NC_GLOBAL", "time_coverage_start",
         F.when(k % 4 == 0, F.concat(F.lit("2024-01-"), day))
         .when(k % 4 != 3, F.concat(F.lit("2024-01-"), day, F.lit("T06:00:00Z")))),
        ("NC_GLOBAL", "time_coverage_end", F.when(k % 9 != 0, F.concat(F.lit("2024-01-2"), (k % 9).cast("string")))),
        ("NC_GLOBAL", "geospatial_lat_min",
         F.when(k % 7 == 0, F.lit("unknown")).when(k % 5 != 0, (k % 90 - 45).cast("string"))),
        ("NC_GLOBAL", "geospatial_lat_max", F.when(k % 6 != 0, F.concat((k % 90 - 40).cast("string"), F.lit(".5")))),
        ("NC_GLOBAL", "geospatial_lon_min", (k % 300 - 150).cast("string")),
        ("NC_GLOBAL", "geospatial_lon_max", F.when(k % 8 != 0, (k % 300 - 130).cast("string"))),
        ("NC_GLOBAL", "contributor_name", F.when(k % 6 != 0, F.col("p_name"))),
        ("NC_GLOBAL", "creator_name", F.when(k % 12 != 0, F.col("p_brand"))),
        ("NC_GLOBAL", "institution",
         F.concat(F.lit("Institute of "), "p_type", F.lit(" and "), "p_brand", F.lit(" studies, building "), text)),
        ("NC_GLOBAL", "platform", F.when(k % 2 == 0, F.lit("glider"))),
        ("NC_GLOBAL", "license", F.when(k % 3 != 0, F.lit("CC-BY"))),
        ("NC_GLOBAL", "cdm_data_type",
         F.when(k % 10 == 0, F.lit("Grid")).when(k % 10 == 1, F.lit("grid")).when(k % 10 < 8, F.lit("TrajectoryProfile"))),
        ("temperature", "standard_name", F.lit("sea_water_temperature")),
        ("temperature", "long_name", F.col("p_name")),
        ("temperature", "units", F.when(k % 8 == 0, F.lit("")).when(k % 9 != 0, F.lit("Celsius"))),
        ("temperature", "ioos_category", F.lit("Temperature")),
        ("temperature", "valid_min", F.lit("-2")),
        ("salinity", "standard_name", F.lit("sea_water_practical_salinity")),
        ("salinity", "units", F.lit("1")),
        ("temperature_qc", "long_name", F.concat(F.lit("quality of "), "p_name")),
        (F.concat(F.lit("extra_"), (k % 13).cast("string"), F.lit("_Flag")), "units", F.lit("1")),
        ("depth", "units", F.lit("m")),
    ]
    cells = F.array(*(
        F.struct(
            (F.lit(v) if isinstance(v, str) else v).alias("variable_name"),
            F.lit(a).alias("attribute_name"), value.alias("value"),
        ) for v, a, value in rows
    ))
    return (
        table(spark, sf_dir, "part").select(text.alias("dataset_id"), F.explode(cells).alias("c"))
        .select("dataset_id", F.lit("attribute").alias("row_type"), "c.*")
        .filter("value IS NOT NULL")
    )


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, nations, market segments and customers as catalogs; suppliers and orders as leaves.

    Every fourth nation also refers to an archive catalog that cannot be read.
    """
    def url(*parts) -> F.Column:
        texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
        return F.concat(F.lit("https://files.example.org/"), *texts, F.lit("/catalog.xml"))

    region, nation, customer, supplier, orders = (
        table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders")
    )
    segments = customer.select("c_nationkey", "c_mktsegment").distinct()
    r_url = url("r/", F.col("r_regionkey"))
    n_url = url("n/", F.col("n_nationkey"))
    s_url = url("n/", F.col("c_nationkey"), "/", F.col("c_mktsegment"))
    c_url = url("c/", F.col("c_custkey"))
    zero = F.lit(0)

    def edge(rows, parent, name, child, pos):
        return rows.select(
            parent.alias("parent_url"), name.alias("ref_name"), child.alias("child_url"), pos.cast("int").alias("pos")
        )

    edges = [
        edge(region, F.lit(ROOT_URL), F.col("r_name"), r_url, F.col("r_regionkey")),
        edge(nation, url("r/", F.col("n_regionkey")), F.col("n_name"), n_url, F.col("n_nationkey")),
        edge(nation.filter("n_nationkey % 4 = 0"), n_url, F.lit("archive"), url("gone/", F.col("n_nationkey")), zero),
        edge(segments, url("n/", F.col("c_nationkey")), F.col("c_mktsegment"), s_url, F.lit(1)),
        edge(customer, s_url, F.col("c_name"), c_url, F.col("c_custkey")),
    ]
    catalogs = [
        spark.range(1).select(F.lit(ROOT_URL).alias("catalog_url"), F.lit("root").alias("catalog_name")),
        region.select(r_url, "r_name"),
        nation.select(n_url, "n_name"),
        segments.select(s_url, "c_mktsegment"),
        customer.select(c_url, "c_name"),
    ]
    o = F.col("o_orderkey")
    name = F.concat(F.lit("Order-"), o.cast("string"), F.lit(".nc"))
    http = F.concat(F.lit("https://files.example.org/fileServer/"), o.cast("string"))
    dap = F.concat(F.lit("https://files.example.org/dodsC/"), o.cast("string"))
    services = (
        F.when(o % 5 == 0, F.create_map(F.lit("WMS"), http))
        .when(o % 5 == 1, F.create_map(F.lit("OpenDAP"), dap))
        .when(o % 5 == 2, F.create_map(F.lit("HTTPServer"), http))
        .otherwise(F.create_map(F.lit("OpenDAP"), dap, F.lit("HTTPServer"), http))
    )
    leaves = [
        supplier.select(
            url("n/", F.col("s_nationkey")).alias("catalog_url"), F.col("s_name").alias("name"),
            F.create_map(F.lit("OpenDAP"), F.col("s_name")).alias("access_urls"), F.col("s_suppkey").cast("int").alias("pos"),
        ),
        orders.select(url("c/", F.col("o_custkey")), name, services, o.cast("int")),
    ]

    def union(parts):
        first, *rest = parts
        for part in rest:
            first = first.union(part)
        return first

    return union(catalogs), union(edges), union(leaves)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one trajectory of eight profiles with eight observations."""
    v = F.col("vec_id")

    def profile(p):
        return F.struct(
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=p, mins=v.cast("int"))).alias("time"),
            (F.lit(-40.0) + v % 80 + p * F.lit(0.25)).alias("latitude"),
            F.when(v % 9 != 0, F.lit(-100.0) + v % 50 - p * F.lit(0.5)).alias("longitude"),
            F.transform(
                F.slice("embedding", p * 8 + 1, 8),
                lambda x, i: F.struct(
                    (i * F.lit(10.0)).alias("depth"),
                    x.cast("double").alias("temperature"),
                    (F.lit(30.0) + i / F.lit(10.0)).alias("salinity"),
                ),
            ).alias("obs"),
        )

    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("dataset_id"),
        F.concat(F.lit("t"), v.cast("string")).alias("trajectory"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), profile).alias("profiles"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as user requests, each with its own mix of given, blank and odd bounds."""
    k = F.col("o_orderkey")

    def digits(column):
        return column.cast("string")

    return table(spark, sf_dir, "orders").select(
        k.alias("request_id"),
        digits(F.col("o_custkey") % 150).alias("dataset_id"),
        F.when(k % 6 == 1, F.lit(""))
        .when(k % 6 == 2, F.concat(F.lit("2024-01-1"), digits(k % 10)))
        .when(k % 6 == 3, F.concat(F.lit("2024-01-2"), digits(k % 10), F.lit("T01:02:03Z")))
        .when(k % 6 == 4, F.concat(F.lit("now-"), digits(k % 20 + 1), F.lit("days")))
        .when(k % 6 == 5, F.concat(F.lit("2024-02-0"), digits(k % 9 + 1))).alias("min_time"),
        F.when(k % 7 == 1, F.concat(F.lit("2024-01-2"), digits(k % 10)))
        .when(k % 7 == 2, F.concat(F.lit("2024-01-0"), digits(k % 9 + 1), F.lit("T00:00:00Z")))
        .when(k % 7 == 3, F.lit("now"))
        .when(k % 7 == 4, F.lit("soon")).alias("max_time"),
        F.when(k % 4 != 0, (k % 180 - 90).cast("double")).alias("min_lat"),
        F.when(k % 5 != 0, (k * 7 % 180 - 90).cast("double")).alias("max_lat"),
        F.when(k % 3 != 0, (k % 360 - 180).cast("double")).alias("min_lon"),
        F.when(k % 8 != 0, (k * 11 % 360 - 180).cast("double")).alias("max_lon"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as keyword queries: phrases, words, unwanted words, short pieces and everything."""
    d, words = F.col("doc_id"), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))

    def word(i: int):
        return F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("of"))

    text = (
        F.when(d % 7 == 0, F.concat(F.lit('"'), word(1), F.lit(" "), word(2), F.lit('"')))
        .when(d % 7 == 1, F.concat(word(1), F.lit("  "), F.when(word(2).rlike("^[a-z]+$"), F.upper(word(2))).otherwise(word(2))))
        .when(d % 7 == 2, F.concat(word(1), F.lit(" -"), word(3)))
        .when(d % 7 == 3, F.left(word(1), F.lit(2)))
        .when(d % 7 == 4, F.concat(F.left(word(1), F.lit(1)), F.lit(" "), word(2)))
        .when(d % 7 == 5, F.concat(F.lit("all -"), word(1)))
        .otherwise(F.concat(F.lit("record "), d.cast("string")))
    )
    return table(spark, sf_dir, "documents").select(d.alias("query_id"), text.alias("query"))


def mixed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose datasets name their columns in five ways."""
    u, t, s = F.col("dataset_id").cast("int"), F.col("temperature"), F.col("salinity")

    def named(*pairs):
        return F.create_map(*[part for name, value in pairs for part in (F.lit(name), value)])

    values = (
        F.when(u % 5 == 0, named(("temperature (Celsius)", t), ("salinity (1)", s)))
        .when(u % 5 == 1, named(("SALINITY", s), ("Temp", s), ("TEMP", t)))
        .when(u % 5 == 2, named(("temp", t), ("TEMPERATURE", s)))
        .when(u % 5 == 3, named(("water", t)))
        .otherwise(named(("temperature (C)", t), ("temperature (F)", s)))
    )
    return observations(spark, sf_dir).select("dataset_id", "row_idx", "time", values.alias("values"))
