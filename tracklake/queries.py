"""Registered queries over the driver tables, with their SQL counterparts.

The tables are read as domain views: line items as coverage, parts as
features, events as methylation sites, orders as variants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.regions import region_columns
from .operators import counts, intervals, normalise, peaks, profiles, ranges, signal, sites, stats
from .sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The domain views, lazily, over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _bases(self) -> DataFrame:
        return self.raw("lineitem").select("l_linenumber", "l_partkey", F.col("l_returnflag").alias("sample"), F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("plus"), F.col("l_quantity").cast("bigint").alias("value"))

    @staticmethod
    def _segment() -> list[Column]:
        """A base as a segment, after the sums by its narrow keys."""
        contig = F.concat(F.lit("chr"), F.col("l_linenumber").cast("string"))
        return [contig.alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.col("sample")]

    def coverage(self) -> DataFrame:
        plus, value = F.col("plus"), F.col("value")
        by = self._bases().groupBy("l_linenumber", "l_partkey", "sample").agg(
            F.sum(F.when(plus, value)).alias("forward"), F.sum(F.when(~plus, value)).alias("reverse"), F.sum(value).alias("total"), F.max(plus).alias("any_forward"), F.max(~plus).alias("any_reverse"),
        )
        # one row of sums, and from it one for each strand and one for the total
        kinds = F.stack(F.lit(3), F.lit("+"), F.col("forward"), F.col("any_forward"), F.lit("-"), F.col("reverse"), F.col("any_reverse"), F.lit("*"), F.col("total"), F.lit(True))
        return by.select(*self._segment(), kinds.alias("strand", "value", "any")).where("any").drop("any")

    def total(self) -> DataFrame:
        """The coverage's rows of both strands together."""
        by = self._bases().groupBy("l_linenumber", "l_partkey", "sample").agg(F.sum("value").alias("value"))
        return by.select(*self._segment(), F.lit("*").alias("strand"), "value")

    def contigs(self) -> DataFrame:
        length = self.raw("part").agg((F.max("p_partkey") + 1).alias("length"))
        return length.select(F.explode(F.array(*(F.lit(f"chr{i}") for i in range(1, 8)))).alias("contig"), "length")

    def samples(self) -> DataFrame:
        return self.spark.createDataFrame([(0, "A"), (1, "N"), (2, "R")], "sample_idx int, sample_id string")

    def features(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("range_index"), F.concat(F.lit("chr"), (1 + key % 7).cast("string")).alias("contig"), key.alias("start"), (key + F.col("p_size")).alias("end"),
            F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_brand").alias("gene_id"), F.col("p_type").alias("feature"),
        )

    def methylation(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        minute = F.floor((F.unix_timestamp("ts") - 1704067200) / 60)
        rows = self.raw("events").select(F.concat(F.lit("chr"), (1 + F.col("user_id") % 7).cast("string")).alias("contig"), minute.alias("pos"), F.col("event_type").alias("sample"), k.alias("k"))
        sums = rows.groupBy("contig", "pos", "sample").agg(F.sum("k").alias("n_methylated"), F.sum(100 - F.col("k")).alias("n_unmethylated"))
        return sums.withColumn("methylation_pct", 100 * F.col("n_methylated") / (F.col("n_methylated") + F.col("n_unmethylated")))

    def event_samples(self) -> DataFrame:
        kinds = self.raw("events").select(F.col("event_type").alias("sample_id")).distinct()
        return kinds

    def windows(self) -> DataFrame:
        """Features on the minutes of the methylation view."""
        return self.features().withColumns({"start": F.col("start") * 20, "end": F.col("start") * 20 + 400})

    def variants(self) -> DataFrame:
        cents = (F.col("o_totalprice") * 100).cast("bigint")
        return self.raw("orders").select(
            F.concat(F.lit("chr"), F.col("o_orderstatus")).alias("contig"), (F.floor(F.col("o_orderkey") / 4) + 1).alias("pos"), F.col("o_orderpriority").alias("sample"),
            F.substring("o_orderpriority", 1, 1).alias("ref"), F.col("o_orderstatus").alias("alt"), (F.col("o_custkey") % 3).cast("int").alias("genotype"), (cents % 10).cast("int").alias("ad_ref"), (F.floor(cents / 10) % 10).cast("int").alias("ad_alt"),
        )

    def sizes(self) -> DataFrame:
        return self._bases().groupBy("sample").agg(F.sum("value").cast("double").alias("library_size"))

    def matrix(self) -> DataFrame:
        """feature, sample, value of the mean embeddings by label."""
        rows = self.raw("embeddings").select(F.col("label").alias("sample"), F.posexplode("embedding").alias("feature", "v"))
        return rows.groupBy(F.col("feature").cast("bigint").alias("feature"), "sample").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("value"))


COV = """cov2 AS (SELECT 'chr' || l_linenumber AS contig, l_partkey AS start, l_partkey + 1 AS "end", l_returnflag AS sample,
 CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem GROUP BY ALL),
cov AS (SELECT * FROM cov2 UNION ALL SELECT contig, start, "end", sample, '*', sum(value)::BIGINT FROM cov2 GROUP BY ALL),
contigs AS (SELECT 'chr' || i AS contig, length FROM range(1, 8) t(i), (SELECT max(p_partkey) + 1 AS length FROM part)),
samples AS (SELECT unnest(['A', 'N', 'R']) AS sample),
features AS (SELECT p_partkey AS range_index, 'chr' || (1 + p_partkey % 7) AS contig, p_partkey AS start, p_partkey + p_size AS "end",
 CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS gene_id, p_type AS feature FROM part)"""
METHYL = """methyl AS (SELECT 'chr' || (1 + user_id % 7) AS contig, floor((epoch(ts) - 1704067200) / 60)::BIGINT AS pos, event_type AS sample,
 sum(k)::BIGINT AS n_methylated, sum(100 - k)::BIGINT AS n_unmethylated, 100 * sum(k) / sum(100) AS methylation_pct
 FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY ALL),
kinds AS (SELECT DISTINCT event_type AS sample FROM events),
wins AS (SELECT p_partkey AS range_index, 'chr' || (1 + p_partkey % 7) AS contig, p_partkey * 20 AS start, p_partkey * 20 + 400 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"""
VARIANTS = """variants AS (SELECT 'chr' || o_orderstatus AS contig, floor(o_orderkey / 4)::BIGINT + 1 AS pos, o_orderpriority AS sample, substr(o_orderpriority, 1, 1) AS ref, o_orderstatus AS alt,
 (o_custkey % 3)::INT AS genotype, (trunc(o_totalprice * 100)::BIGINT % 10)::INT AS ad_ref, (floor(trunc(o_totalprice * 100) / 10)::BIGINT % 10)::INT AS ad_alt FROM orders)"""
MATRIX = """matrix AS (SELECT label AS sample, feature, round(avg(v::DOUBLE), 9) AS value FROM (SELECT label, unnest(range(64)) AS feature, unnest(embedding) AS v FROM embeddings) GROUP BY ALL)"""
PER_BASE = """clipped AS (SELECT f.range_index, f.contig, greatest(f.start, 0) AS start, least(f."end", c.length) AS "end", f.strand, f.gene_id FROM features f JOIN contigs c USING (contig) WHERE least(f."end", c.length) > greatest(f.start, 0)),
bases AS (SELECT range_index, contig, strand, gene_id, "end" - start AS len, unnest(range(start, "end")) AS pos FROM clipped),
cells AS (SELECT b.*, s.sample, coalesce(v.value, 0) AS value FROM bases b CROSS JOIN samples s LEFT JOIN cov v ON v.contig = b.contig AND v.start = b.pos AND v.sample = s.sample AND v.strand = '*')"""


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _reduced(v: Views, *names: str, mode=None, min_count: int = 1) -> DataFrame:
    return signal.reduce_ranges(v.coverage() if mode else v.total(), v.features(), v.contigs(), v.samples(), list(names), mode, min_count)


# --- reduction -------------------------------------------------------------

@query(f"WITH {COV}, {PER_BASE} SELECT range_index, contig, min(pos) AS start, max(pos) + 1 AS \"end\", sample, sum(value)::BIGINT AS sum, count(*) AS count, sum(value) / count(*) AS mean FROM cells GROUP BY range_index, contig, sample")
def reduce_mean(v: Views) -> DataFrame:
    return _reduced(v).select("range_index", "contig", "start", "end", "sample", "sum", "count", "mean")


for _name in ("sum", "max", "min"):
    def _one(v: Views, name: str = _name) -> DataFrame:
        return _reduced(v, name).select("range_index", "sample", name)

    _one.__name__ = f"reduce_{_name}"
    query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, {_name}(value)::BIGINT AS {_name} FROM cells GROUP BY ALL")(_one)


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, median(value)::DOUBLE AS median, max(value)::BIGINT AS max, min(value)::BIGINT AS min FROM cells GROUP BY range_index, sample")
def reduce_median(v: Views) -> DataFrame:
    return _reduced(v, "median", "max", "min").select("range_index", "sample", "median", "max", "min")


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, CASE WHEN count(*) >= 20 THEN sum(value) / count(*) END AS mean FROM cells GROUP BY range_index, sample")
def reduce_min_count(v: Views) -> DataFrame:
    return _reduced(v, min_count=20).select("range_index", "sample", "mean")


for _mode, _case in ((1, "b.strand"), (2, "CASE b.strand WHEN '+' THEN '-' ELSE '+' END")):
    def _two(v: Views, mode: int = _mode) -> DataFrame:
        return _reduced(v, mode=mode).select("range_index", "sample", "sum", "mean")

    _two.__name__ = f"reduce_strand{_mode}"
    query(f"WITH {COV}, {PER_BASE} SELECT b.range_index, s.sample, sum(coalesce(v.value, 0))::BIGINT AS sum, sum(coalesce(v.value, 0)) / count(*) AS mean FROM bases b CROSS JOIN samples s LEFT JOIN cov v ON v.contig = b.contig AND v.start = b.pos AND v.sample = s.sample AND v.strand = {_case} GROUP BY b.range_index, s.sample")(_two)


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, sum(value)::BIGINT AS sum FROM cells GROUP BY range_index, sample ORDER BY range_index, sample")
def reduce_ordered(v: Views) -> DataFrame:
    return _reduced(v).select("range_index", "sample", "sum").orderBy("range_index", "sample")


# --- counts ------------------------------------------------------------------

def _counts(v: Views, **options) -> DataFrame:
    return counts.count_features(v.total(), v.features(), v.contigs(), v.samples(), **options)[0]


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, sum(value)::BIGINT AS count FROM cells GROUP BY range_index, sample")
def count_features(v: Views) -> DataFrame:
    return _counts(v)


@query(f"WITH {COV}, {PER_BASE} SELECT gene_id, sample, sum(value)::BIGINT AS count FROM cells GROUP BY gene_id, sample")
def count_features_by_gene(v: Views) -> DataFrame:
    return _counts(v, aggregate_by="gene_id")


@query(f"WITH {COV} SELECT gene_id, arg_min(contig, range_index) AS contig, arg_min(strand, range_index) AS strand, min(start) AS start, max(\"end\") AS \"end\", sum(\"end\" - start)::BIGINT AS length FROM features GROUP BY gene_id")
def count_metadata_by_gene(v: Views) -> DataFrame:
    return counts.rollup_metadata(v.features(), ["gene_id"])


@query(f"WITH {COV}, {PER_BASE}, c AS (SELECT range_index, sample, sum(value)::BIGINT AS count FROM cells GROUP BY range_index, sample) SELECT * FROM c WHERE range_index IN (SELECT range_index FROM c GROUP BY 1 HAVING max(abs(count)) > 0)")
def count_filter_zero(v: Views) -> DataFrame:
    return _counts(v, filter_zero=True)


@query(f"WITH {COV}, {PER_BASE}, c AS (SELECT range_index, sample, sum(value) / 4.0 AS q FROM cells GROUP BY range_index, sample) SELECT range_index, sample, round_even(q, 0)::BIGINT AS count FROM c")
def count_integerize(v: Views) -> DataFrame:
    return counts.integers(_counts(v, integerize=False).withColumn("count", F.col("count") / 4))


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, coalesce(sum(value) FILTER (sample = 'A'), 0)::BIGINT AS \"A\", coalesce(sum(value) FILTER (sample = 'N'), 0)::BIGINT AS \"N\", coalesce(sum(value) FILTER (sample = 'R'), 0)::BIGINT AS \"R\" FROM cells GROUP BY range_index")
def count_matrix_pivot(v: Views) -> DataFrame:
    return counts.to_matrix(_counts(v), ["range_index"], ["A", "N", "R"])


@query(f"WITH {COV}, {PER_BASE} SELECT range_index, sample, sum(value)::BIGINT AS count FROM cells WHERE strand = '+' GROUP BY range_index, sample")
def count_strand_filter(v: Views) -> DataFrame:
    return _counts(v, strand="+")


# --- normalisation -----------------------------------------------------------

SIZES = "sizes AS (SELECT sample, sum(value)::DOUBLE AS n FROM cov WHERE strand = '*' GROUP BY sample), c AS (SELECT range_index, sample, len, sum(value)::DOUBLE AS x FROM cells GROUP BY ALL)"


def _normalised(v: Views, method: str) -> DataFrame:
    reduced = normalise.normalise_reduced(_reduced(v), v.sizes(), method, strict=method != "tpm")
    return reduced.select("range_index", "sample", F.round("sum", 6).alias("value"))


@query(f"WITH {COV}, {PER_BASE}, {SIZES} SELECT range_index, sample, round(x / (n / 1e6), 6) AS value FROM c JOIN sizes USING (sample)")
def normalise_cpm(v: Views) -> DataFrame:
    return _normalised(v, "cpm")


@query(f"WITH {COV}, {PER_BASE}, {SIZES} SELECT range_index, sample, round(x / (n / 1e6) / (len / 1000), 6) AS value FROM c JOIN sizes USING (sample)")
def normalise_rpkm(v: Views) -> DataFrame:
    return _normalised(v, "rpkm")


@query(f"WITH {COV}, {PER_BASE}, {SIZES} SELECT range_index, sample, round(x / (len / 1000) / (sum(x / (len / 1000)) OVER (PARTITION BY sample) / 1e6), 6) AS value FROM c")
def normalise_tpm(v: Views) -> DataFrame:
    return _normalised(v, "tpm")


# --- windows -----------------------------------------------------------------

def _window_sql(start: str, bins: str, step: int, agg: str, strand: str = "'*'", up: int = 0) -> str:
    return f"""WITH {COV}, w AS (SELECT f.range_index, f.contig, f.strand, {start} AS ws, {bins} AS n, c.length FROM features f JOIN contigs c USING (contig)),
b AS (SELECT *, unnest(range(n)) AS bin FROM w WHERE n > 0),
p AS (SELECT range_index, contig, strand, bin, length, unnest(range(ws + bin * {step}, ws + (bin + 1) * {step})) AS pos FROM b),
x AS (SELECT p.range_index, p.bin, s.sample, CASE WHEN p.pos >= 0 AND p.pos < p.length THEN coalesce(v.value, 0) END AS value FROM p CROSS JOIN samples s LEFT JOIN cov v ON v.contig = p.contig AND v.start = p.pos AND v.sample = s.sample AND v.strand = {strand})
SELECT range_index, bin, sample, (bin * {step} - {up})::BIGINT AS "offset", {agg}(value)::DOUBLE AS value FROM x GROUP BY range_index, bin, sample"""


def _windows(v: Views, **options) -> DataFrame:
    found = signal.extract_windows(v.coverage() if options.get("strand_aware") else v.total(), v.features(), v.contigs(), v.samples(), **options)
    return found.select("range_index", "bin", "sample", "offset", "value")


_MID = "floor((f.start + f.\"end\") / 2)::BIGINT"


@query(_window_sql(f"{_MID} - 20", "4", 10, "avg", up=20))
def extract_midpoint_binned_mean(v: Views) -> DataFrame:
    return _windows(v, fixed_width=40, bin_size=10)


@query(_window_sql("(CASE WHEN f.strand = '-' THEN f.\"end\" ELSE f.start END) - 10", "3", 10, "sum", up=10))
def extract_start_strand(v: Views) -> DataFrame:
    return _windows(v, upstream=10, downstream=20, anchor="start", bin_size=10, bin_agg="sum")


@query(_window_sql("(CASE WHEN f.strand = '-' THEN f.start ELSE f.\"end\" END) - 10", "2", 10, "avg", up=10))
def extract_end(v: Views) -> DataFrame:
    return _windows(v, upstream=10, downstream=10, anchor="end", bin_size=10)


@query(_window_sql("f.start", "(f.\"end\" - f.start) // 5", 5, "avg"))
def extract_variable_len(v: Views) -> DataFrame:
    return _windows(v, bin_size=5)


@query(_window_sql(f"{_MID} - 10", "2", 10, "max", up=10))
def extract_bin_max(v: Views) -> DataFrame:
    return _windows(v, fixed_width=20, bin_size=10, bin_agg="max")


@query(_window_sql(f"{_MID} - 10", "2", 10, "min", up=10))
def extract_bin_min(v: Views) -> DataFrame:
    return _windows(v, fixed_width=20, bin_size=10, bin_agg="min")


@query(_window_sql(f"{_MID} - 10", "2", 10, "median", up=10))
def extract_bin_median(v: Views) -> DataFrame:
    return _windows(v, fixed_width=20, bin_size=10, bin_agg="median")


@query(_window_sql(f"{_MID} - 10", "4", 5, "avg", strand="p.strand", up=10))
def extract_strand_aware(v: Views) -> DataFrame:
    return _windows(v, fixed_width=20, bin_size=5, strand_aware=True)


# --- regions -----------------------------------------------------------------

@query(f"WITH {COV} SELECT * FROM cov WHERE contig = 'chr2' AND strand = '*' AND \"end\" > 20 AND start < 120")
def region_slice(v: Views) -> DataFrame:
    return signal.region_slice(v.coverage(), v.contigs(), "chr2", 20, 120)


@query(f"WITH {COV} SELECT s.sample, p.pos, coalesce(v.value, 0) AS value FROM (SELECT unnest(range(20, 120)) AS pos) p CROSS JOIN samples s LEFT JOIN cov v ON v.contig = 'chr2' AND v.strand = '*' AND v.start = p.pos AND v.sample = s.sample")
def region_dense(v: Views) -> DataFrame:
    return signal.region_dense(v.coverage(), v.contigs(), v.samples(), "chr2", 20, 120)


@query(f"WITH {METHYL} SELECT contig, pos, sample, n_methylated, n_unmethylated FROM methyl WHERE contig = 'chr3' AND pos >= 100 AND pos < 5000")
def region_methyl(v: Views) -> DataFrame:
    return sites.site_region(v.methylation(), "chr3", 100, 5000).drop("methylation_pct")


@query(f"WITH {VARIANTS} SELECT contig, pos, sample, genotype FROM variants WHERE contig = 'chrO' AND pos BETWEEN 10 AND 200")
def region_variant_inclusive(v: Views) -> DataFrame:
    return sites.site_region(v.variants(), "chrO", 10, 200, inclusive=True).select("contig", "pos", "sample", "genotype")


@query(f"WITH {METHYL} SELECT DISTINCT contig, pos FROM methyl")
def positions_union(v: Views) -> DataFrame:
    return sites.positions(v.methylation())


@query(f"WITH {VARIANTS}, o AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS i FROM (SELECT DISTINCT sample FROM variants)) SELECT contig, pos, arg_min(ref, i) AS ref, arg_min(alt, i) AS alt FROM variants JOIN o USING (sample) GROUP BY contig, pos")
def alleles_first(v: Views) -> DataFrame:
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    found = v.variants()
    names = v.spark.createDataFrame(list(enumerate(order)), "sample_idx int, sample_id string")
    return sites.alleles(found, names)


# --- interval algebra ----------------------------------------------------------

BLACK = "black AS (SELECT contig, start, \"end\" FROM features WHERE \"end\" - start > 45)"


def _black(v: Views) -> DataFrame:
    return v.features().where("end - start > 45").select("contig", "start", "end")


@query(f"WITH {COV}, {BLACK} SELECT f.range_index, f.contig, f.start, f.\"end\", b.start AS feature_start, b.\"end\" AS feature_end FROM features f JOIN black b ON f.contig = b.contig AND f.start < b.\"end\" AND b.start < f.\"end\"")
def annotate_inner(v: Views) -> DataFrame:
    return intervals.annotate(v.features(), _black(v)).select("range_index", "contig", "start", "end", "feature_start", "feature_end")


@query(f"WITH {COV}, {BLACK} SELECT f.range_index, f.contig, f.start, f.\"end\", b.start AS feature_start, b.\"end\" AS feature_end FROM features f LEFT JOIN black b ON f.contig = b.contig AND f.start < b.\"end\" AND b.start < f.\"end\"")
def annotate_left(v: Views) -> DataFrame:
    return intervals.annotate(v.features(), _black(v), require_overlap=False).select("range_index", "contig", "start", "end", "feature_start", "feature_end")


@query(f"WITH {COV}, {BLACK}, p AS (SELECT DISTINCT contig, start AS pos FROM cov) SELECT contig, pos, EXISTS (SELECT 1 FROM black b WHERE b.contig = p.contig AND p.pos >= b.start AND p.pos < b.\"end\") AS in_range FROM p")
def mask_positions(v: Views) -> DataFrame:
    return intervals.position_mask(v.total().select("contig", F.col("start").alias("pos")).distinct(), _black(v))


MERGE = """o AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM features),
k AS (SELECT *, sum(opens) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o)"""


@query(f"WITH {COV}, {MERGE} SELECT contig, min(start) AS start, max(\"end\") AS \"end\" FROM k GROUP BY contig, k")
def merge_ranges(v: Views) -> DataFrame:
    return intervals.merge_ranges(v.features())


@query(f"WITH {COV}, {MERGE} SELECT contig, min(start) AS start, max(\"end\") AS \"end\", string_agg(gene_id, ';' ORDER BY start, \"end\", gene_id) AS gene_id FROM k GROUP BY contig, k")
def merge_annotate(v: Views) -> DataFrame:
    return intervals.merge_ranges(v.features(), annotations=["gene_id"])


@query(f"WITH {COV} SELECT contig, s AS start, least(s + 300, length) AS \"end\", (row_number() OVER (ORDER BY contig, s) - 1)::BIGINT AS ranges_id FROM (SELECT contig, length, unnest(range(0, length, 300)) AS s FROM contigs)")
def fixed_windows(v: Views) -> DataFrame:
    return intervals.numbered(intervals.fixed_windows(v.contigs(), 300))


SUBTRACT = """pos AS (SELECT range_index, contig, unnest(range(start, "end")) AS p FROM l),
kept AS (SELECT * FROM pos WHERE NOT EXISTS (SELECT 1 FROM black b WHERE b.contig = pos.contig AND p >= b.start AND p < b."end")),
isle AS (SELECT *, p - row_number() OVER (PARTITION BY range_index, contig ORDER BY p) AS g FROM kept)"""


@query(f"WITH {COV}, {BLACK}, l AS (SELECT range_index, contig, start, \"end\" FROM features), {SUBTRACT} SELECT range_index, contig, min(p) AS start, max(p) + 1 AS \"end\" FROM isle GROUP BY range_index, contig, g")
def subtract(v: Views) -> DataFrame:
    return intervals.subtract(v.features().select("range_index", "contig", "start", "end"), _black(v))


@query(f"WITH {COV}, {BLACK}, l AS (SELECT s AS range_index, contig, s AS start, least(s + 128, length) AS \"end\" FROM (SELECT contig, length, unnest(range(0, length, 128)) AS s FROM contigs)), {SUBTRACT} SELECT contig, min(p) AS start, max(p) + 1 AS \"end\" FROM isle GROUP BY range_index, contig, g")
def tiles_blacklisted(v: Views) -> DataFrame:
    return intervals.subtract(intervals.tile_genome(v.contigs(), 128), _black(v))


@query(f"WITH {COV} SELECT range_index, contig, greatest(0, t - 100)::BIGINT AS start, (t + 20)::BIGINT AS \"end\" FROM (SELECT *, CASE WHEN strand = '-' THEN \"end\" ELSE start END AS t FROM features)")
def promoters(v: Views) -> DataFrame:
    return ranges.promoters(v.features().withColumn("feature", F.lit("gene")), 100, 20).select("range_index", "contig", "start", "end")


@query(f"WITH {COV} SELECT range_index, \"end\" - start AS length, floor((start + \"end\") / 2)::BIGINT AS midpoint FROM features")
def feature_lengths(v: Views) -> DataFrame:
    return ranges.feature_ranges(v.features().withColumn("feature", F.lit("exon")), "exon").select("range_index", "length", "midpoint")


@query(f"WITH {COV}, a AS (SELECT DISTINCT contig FROM features), b AS (SELECT contig FROM contigs WHERE contig <> 'chr7' UNION SELECT 'chr9') SELECT coalesce(a.contig, b.contig) AS contig, CASE WHEN a.contig IS NULL THEN 'store' WHEN b.contig IS NULL THEN 'ranges' ELSE 'shared' END AS found_in FROM a FULL JOIN b ON a.contig = b.contig")
def contig_overlap(v: Views) -> DataFrame:
    own = v.contigs().where("contig <> 'chr7'").select("contig").union(v.spark.createDataFrame([("chr9",)], "contig string"))
    return intervals.contig_overlap(v.features(), own)


# --- sites -----------------------------------------------------------------------

@query(f"""WITH {METHYL}, j AS (SELECT w.range_index, m.* EXCLUDE (contig) FROM wins w JOIN methyl m ON m.contig = w.contig AND m.pos >= w.start AND m.pos < w."end"),
s AS (SELECT range_index, sample, sum(n_methylated)::BIGINT AS n_methylated, sum(n_unmethylated)::BIGINT AS n_unmethylated, count(methylation_pct) AS n_cpg_covered, avg(methylation_pct) AS mean_pct FROM j GROUP BY ALL),
t AS (SELECT range_index, count(DISTINCT pos) AS n_cpg_total FROM j GROUP BY ALL)
SELECT w.range_index, k.sample, coalesce(n_methylated, 0) AS n_methylated, coalesce(n_unmethylated, 0) AS n_unmethylated, coalesce(n_cpg_covered, 0) AS n_cpg_covered, round(mean_pct, 6) AS mean_pct, coalesce(n_cpg_total, 0) AS n_cpg_total,
CASE WHEN n_methylated + n_unmethylated > 0 THEN n_methylated / (n_methylated + n_unmethylated) END AS methylation_ratio FROM wins w CROSS JOIN kinds k LEFT JOIN s ON s.range_index = w.range_index AND s.sample = k.sample LEFT JOIN t ON t.range_index = w.range_index""")
def methyl_count_features(v: Views) -> DataFrame:
    found = sites.count_methylation(v.methylation(), v.windows(), v.event_samples())
    return found.withColumn("mean_pct", F.round("mean_pct", 6)).drop("contig", "start", "end")


@query(f"""WITH {METHYL}, j AS (SELECT w.range_index, m.sample, m.methylation_pct, CASE WHEN w.strand = '-' THEN 399 - (m.pos - w.start) ELSE m.pos - w.start END AS r FROM wins w JOIN methyl m ON m.contig = w.contig AND m.pos >= w.start AND m.pos < w.start + 400),
s AS (SELECT range_index, (r * 8) // 400 AS bin, sample, avg(methylation_pct) AS value FROM j GROUP BY ALL)
SELECT w.range_index, b.bin, k.sample, round(s.value, 6) AS value FROM wins w CROSS JOIN (SELECT unnest(range(8)) AS bin) b CROSS JOIN kinds k LEFT JOIN s ON s.range_index = w.range_index AND s.bin = b.bin AND s.sample = k.sample""")
def methyl_extract_bins(v: Views) -> DataFrame:
    found = sites.methylation_windows(v.methylation(), v.windows(), v.event_samples(), 8, fixed_width=400)
    return found.withColumn("value", F.round("value", 6))


_REPORT = "SELECT 'chr' || l_linenumber AS contig, l_partkey AS pos, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, sum(l_quantity::BIGINT)::BIGINT AS n_mc, count(*) AS n_hmc, sum(l_orderkey % 9)::BIGINT AS n_c FROM lineitem GROUP BY ALL"


def _report(v: Views) -> DataFrame:
    rows = v.raw("lineitem").select(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("contig"), F.col("l_partkey").alias("pos"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_orderkey") % 9).alias("o"))
    return rows.groupBy("contig", "pos", "strand").agg(F.sum("q").alias("n_mc"), F.count(F.lit(1)).alias("n_hmc"), F.sum("o").alias("n_c"))


@query(f"WITH r AS ({_REPORT}), s AS (SELECT contig, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END AS pos, sum(n_mc) AS mc, sum(n_hmc) AS h, sum(n_c) AS c FROM r GROUP BY ALL) SELECT contig, pos, least(mc, 65535)::INT AS n_mc, least(h, 65535)::INT AS n_hmc, least(c, 65535)::INT AS n_c, CASE WHEN mc + h + c > 0 THEN round(100 * ((mc + h) / (mc + h + c)), 9) END AS methylation_pct FROM s")
def cpg_strand_merge(v: Views) -> DataFrame:
    return sites.merge_strands(_report(v)).withColumn("methylation_pct", F.round("methylation_pct", 9))


@query(f"WITH r AS ({_REPORT}) SELECT contig, pos, strand, n_mc, n_hmc, greatest(n_mc + n_c - n_mc - n_hmc, 0) AS n_c FROM r")
def split_cx_join(v: Views) -> DataFrame:
    report = _report(v)
    mc = report.select("contig", "pos", "strand", F.col("n_mc").alias("n_mod"), F.col("n_c").alias("n_not_mod"))
    hmc = report.select("contig", "pos", "strand", F.col("n_hmc").alias("n_mod"), F.col("n_c").alias("n_not_mod"))
    return sites.join_split_reports(mc, hmc)


@query(f"WITH {METHYL} SELECT contig, pos, sample, n_methylated AS n_mc, 0 AS n_hmc, n_unmethylated AS n_c FROM methyl")
def mixed_schema_union(v: Views) -> DataFrame:
    return sites.as_split(v.methylation()).select("contig", "pos", "sample", "n_mc", "n_hmc", "n_c")


@query("SELECT 'chr' || l_linenumber AS contig, l_partkey AS pos, l_discount * 1000 AS pct, round_even(l_discount * 1000 / 100 * l_quantity, 0)::INT AS n_methylated, round_even((1 - l_discount * 1000 / 100) * l_quantity, 0)::INT AS n_unmethylated FROM lineitem")
def bedgraph5_counts(v: Views) -> DataFrame:
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string"), (F.col("l_partkey") + 1).cast("string"), (F.col("l_discount") * 1000).cast("string"), F.col("l_quantity").cast("string"))
    rows = v.raw("lineitem").select(line.alias("value")).select("value", F.split("value", "\t").alias("f"))
    return text.bedgraph_sites(rows, "s").select("contig", "pos", F.col("methylation_pct").alias("pct"), "n_methylated", "n_unmethylated")


AF = f"WITH {VARIANTS}, a AS (SELECT contig, pos, sample, CASE WHEN ad_ref + ad_alt > 0 THEN ad_alt / (ad_ref + ad_alt) END AS allele_frequency FROM variants)"


@query(f"{AF} SELECT * FROM a")
def allele_frequency(v: Views) -> DataFrame:
    return sites.allele_frequency(v.variants()).select("contig", "pos", "sample", "allele_frequency")


@query(f"{AF} SELECT CASE WHEN allele_frequency >= 0.8 THEN 'hom_alt' WHEN allele_frequency > 0.2 THEN 'het' WHEN allele_frequency IS NOT NULL THEN 'hom_ref' END AS genotype_class, count(*) AS n FROM a GROUP BY 1")
def genotype_class(v: Views) -> DataFrame:
    return sites.allele_frequency(v.variants()).groupBy("genotype_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {COV}, n AS (SELECT sample, contig, sum(\"end\" - start) AS n FROM cov WHERE strand = '*' GROUP BY ALL) SELECT s.sample, round(avg(100 * (1 - coalesce(n, 0) / length)), 9) AS sparsity FROM samples s CROSS JOIN contigs c LEFT JOIN n ON n.sample = s.sample AND n.contig = c.contig GROUP BY s.sample")
def sparsity(v: Views) -> DataFrame:
    return signal.sparsity(v.total(), v.contigs(), v.samples()).withColumn("sparsity", F.round("sparsity", 9))


@query(f"WITH {COV} SELECT sample, CASE WHEN sample <> 'N' THEN sum(value)::DOUBLE END AS library_size FROM cov WHERE strand = '*' GROUP BY sample")
def library_sizes(v: Views) -> DataFrame:
    totals = v.sizes().select(F.col("sample").alias("sample_id"), F.col("library_size").cast("bigint").alias("total_reads"), (F.col("sample") != "N").alias("completed"))
    return signal.library_sizes(totals)


# --- profiles and statistics -------------------------------------------------------

_W = _window_sql(f"{_MID} - 20", "4", 10, "avg", up=20)


@query(f"SELECT sample AS label, bin, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS err FROM (SELECT w.* REPLACE (CASE WHEN f.p_partkey % 2 = 1 THEN 3 - bin ELSE bin END AS bin) FROM ({_W}) w JOIN part f ON f.p_partkey = w.range_index) GROUP BY 1, 2")
def metaplot_profile(v: Views) -> DataFrame:
    wins = signal.extract_windows(v.total(), v.features(), v.contigs(), v.samples(), fixed_width=40, bin_size=10)
    found = profiles.metaplot(profiles.orient(wins, 4))
    return found.withColumns({"mean": F.round("mean", 6), "err": F.round("err", 6)})


@query(f"SELECT label, bin, round(avg(m), 6) AS mean, round(stddev_pop(m) / sqrt(count(m)), 6) AS err FROM (SELECT sample, CASE WHEN sample = 'A' THEN 'x' ELSE 'y' END AS label, bin, avg(value) AS m FROM ({_W}) GROUP BY ALL) GROUP BY label, bin")
def metaplot_groups(v: Views) -> DataFrame:
    groups = v.spark.createDataFrame([("A", "x"), ("N", "y"), ("R", "y")], "sample string, label string")
    found = profiles.metaplot(_windows(v, fixed_width=40, bin_size=10), groups)
    return found.withColumns({"mean": F.round("mean", 6), "err": F.round("err", 6)})


@query(f"SELECT w.sample AS panel, w.range_index, r.row_rank, w.bin, w.value FROM ({_W}) w JOIN (SELECT range_index, row_number() OVER (ORDER BY max(value) DESC NULLS LAST, range_index) - 1 AS row_rank FROM ({_W}) WHERE sample = 'A' GROUP BY range_index) r USING (range_index)")
def tornado_order(v: Views) -> DataFrame:
    found = profiles.tornado(_windows(v, fixed_width=40, bin_size=10), "max", "A")
    return found.withColumn("row_rank", F.col("row_rank").cast("bigint"))


@query(f"WITH {MATRIX} SELECT a.sample AS sample_a, b.sample AS sample_b, round(corr(a.value, b.value), 6) AS r FROM matrix a JOIN matrix b USING (feature) GROUP BY a.sample, b.sample")
def correlate_pearson(v: Views) -> DataFrame:
    return stats.correlate(v.matrix()).withColumn("r", F.round("r", 6))


@query(f"WITH {MATRIX}, k AS (SELECT feature, sample, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS value FROM matrix) SELECT a.sample AS sample_a, b.sample AS sample_b, round(corr(a.value, b.value), 6) AS r FROM k a JOIN k b USING (feature) GROUP BY a.sample, b.sample")
def correlate_spearman(v: Views) -> DataFrame:
    return stats.correlate(v.matrix(), "spearman").withColumn("r", F.round("r", 6))


@query(f"WITH {MATRIX} SELECT * FROM matrix WHERE sample IN (SELECT sample FROM matrix GROUP BY sample HAVING var_pop(value) > 0)")
def zero_variance_drop(v: Views) -> DataFrame:
    return stats.drop_constant_samples(v.matrix())


@query(f"WITH {MATRIX} SELECT feature, sample, round(ln(1 + abs(value)), 9) AS value FROM matrix")
def log1p_matrix(v: Views) -> DataFrame:
    return stats.log1p(v.matrix().withColumn("value", F.abs("value"))).withColumn("value", F.round("value", 9))


@query(f"WITH {MATRIX} SELECT feature, sample, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12), 5) AS value FROM matrix WINDOW w AS (PARTITION BY feature)")
def standardise(v: Views) -> DataFrame:
    return stats.standardise(v.matrix()).withColumn("value", F.round("value", 5))


@query()
def pca_scores(v: Views) -> DataFrame:
    return stats.pca(v.matrix(), 3)[0]


@query()
def pca_explained_variance(v: Views) -> DataFrame:
    return stats.pca(v.matrix(), 3)[1]


@query()
def heatmap_order(v: Views) -> DataFrame:
    return stats.heatmap_order(v.matrix().withColumn("value", F.abs("value")))


@query()
def subset_random(v: Views) -> DataFrame:
    return stats.subset_features(v.matrix(), 16, "random", 1)


# --- peaks ---------------------------------------------------------------------------

TILES = f"""{COV}, {BLACK}, t AS (SELECT c.contig, s.sample, i.s AS start, least(i.s + 16, c.length) AS "end" FROM contigs c CROSS JOIN samples s, LATERAL (SELECT unnest(range(0, c.length, 16)) AS s) i),
g AS (SELECT t.sample, t.contig, t.start, t."end", sum(v.value) / (t."end" - t.start) AS signal FROM t JOIN cov v ON v.contig = t.contig AND v.sample = t.sample AND v.strand = '*' AND v.start >= t.start AND v.start < t."end" GROUP BY t.sample, t.contig, t.start, t."end"),
h AS (SELECT sample, quantile_cont(signal, 0.9) AS thr FROM g WHERE signal > 0 GROUP BY sample),
p AS (SELECT g.sample, g.contig, g.start, g."end" FROM g JOIN h USING (sample) WHERE signal >= thr)"""


def _tiles(v: Views) -> DataFrame:
    return peaks.tile_signal(v.total().drop("strand"), intervals.tile_genome(v.contigs(), 16))


@query(f"WITH {TILES} SELECT * FROM p")
def quantile_peaks(v: Views) -> DataFrame:
    return peaks.quantile_peaks(_tiles(v), 0.9, merge=False)


@query(f"""WITH {TILES}, o AS (SELECT *, CASE WHEN start <= lag("end") OVER (PARTITION BY sample, contig ORDER BY start) THEN 0 ELSE 1 END AS opens FROM p),
l AS (SELECT sample || contig || k AS range_index, sample, contig, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY sample, contig ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM o) GROUP BY sample, contig, k), {SUBTRACT}
SELECT l.sample, i.contig, min(p) AS start, max(p) + 1 AS "end" FROM isle i JOIN l USING (range_index) GROUP BY l.sample, range_index, i.contig, g""")
def peaks_merged_blacklisted(v: Views) -> DataFrame:
    return peaks.quantile_peaks(_tiles(v), 0.9, True, _black(v), slack=1)


# --- text --------------------------------------------------------------------------------

@query("SELECT 'chr' || p_size AS contig, p_partkey AS start, p_partkey + p_size + 1 AS \"end\", CASE WHEN p_partkey % 3 = 0 THEN '+' WHEN p_partkey % 3 = 1 THEN '-' END AS strand, 'exon' AS feature, p_brand AS gene_id, p_type AS gene_name FROM part")
def gtf_parse(v: Views) -> DataFrame:
    key = F.col("p_partkey")
    strand = F.when(key % 3 == 0, "+").when(key % 3 == 1, "-").otherwise(".")
    attributes = F.concat(F.lit('gene_id "'), F.col("p_brand"), F.lit('"; gene_name "'), F.col("p_type"), F.lit('"; note;'))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.lit("src"), F.lit("exon"), (key + 1).cast("string"), (key + F.col("p_size") + 1).cast("string"), F.lit("."), strand, F.lit("."), attributes)
    rows = v.raw("part").select(line.alias("value")).select("value", F.split("value", "\t").alias("f"))
    return text.gtf_rows(rows).select("contig", "start", "end", "strand", "feature", "gene_id", "gene_name")


@query("SELECT o_orderkey AS id, 'chr' || (o_custkey % 9) AS contig, o_orderkey * 1000 AS start, o_orderkey * 1000 + o_custkey + 1 AS \"end\" FROM orders")
def region_string_parse(v: Views) -> DataFrame:
    start = F.col("o_orderkey") * 1000
    region = F.concat(F.lit("chr"), (F.col("o_custkey") % 9).cast("string"), F.lit(":"), F.format_number(start, 0), F.lit("-"), F.format_number(start + F.col("o_custkey") + 1, 0))
    return v.raw("orders").select(F.col("o_orderkey").alias("id"), *region_columns(region))


@query("SELECT o_orderkey AS pos, 'A' AS ref, 'T' AS alt, o_totalprice AS qual, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END::INT AS genotype, (o_custkey % 50)::INT AS ad_ref, (o_custkey % 7)::INT AS ad_alt FROM orders")
def vcf_parse(v: Views) -> DataFrame:
    c = F.col("o_custkey")
    gt = F.when(c % 4 == 0, "0/0").when(c % 4 == 1, "0|1").when(c % 4 == 2, "1/2").otherwise("./.")
    call = F.concat_ws(":", gt, F.lit("9"), F.concat_ws(",", (c % 50).cast("string"), (c % 7).cast("string")))
    line = F.concat_ws("\t", F.lit("chr1"), F.col("o_orderkey").cast("string"), F.lit("."), F.lit("A"), F.lit("T,G"), F.col("o_totalprice").cast("string"), F.lit("PASS"), F.lit("."), F.lit("GT:DP:AD"), call)
    rows = v.raw("orders").select(line.alias("value")).select("value", F.split("value", "\t").alias("f"))
    return text.vcf_calls(rows, "s").select("pos", "ref", "alt", "qual", "genotype", "ad_ref", "ad_alt")


# --- dimension tables ------------------------------------------------------------------------

@query("SELECT s_suppkey::VARCHAR AS sample_id, coalesce(n_name, s_name) AS label, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def metadata_merge(v: Views) -> DataFrame:
    from .plans.store import merged_metadata

    samples = v.raw("supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("s_name").alias("label"))
    named = v.raw("supplier").join(v.raw("nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"))
    fresh = named.select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("n_name").alias("label"), F.col("n_name").alias("nation"))
    return merged_metadata(samples, fresh, ["sample_id"])


@query("WITH a AS (SELECT DISTINCT o_orderpriority AS sample_id, 0 AS m, 'coverage' AS n FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 1, 'methylation' FROM orders WHERE o_orderpriority < '3' UNION ALL SELECT 'extra', 2, 'variants') SELECT sample_id, string_agg(n, ',' ORDER BY m) AS modalities FROM a GROUP BY sample_id")
def metadata_combined(v: Views) -> DataFrame:
    from .plans.store import combined_metadata

    names = v.raw("orders").select(F.col("o_orderpriority").alias("sample_id")).distinct()
    return combined_metadata({"coverage": names, "methylation": names.where("sample_id < '3'"), "variants": v.spark.createDataFrame([("extra",)], "sample_id string")})


@query("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_antijoin(v: Views) -> DataFrame:
    from .plans.store import unfinished

    samples = v.raw("orders").select(F.col("o_custkey").alias("sample_id"), (F.col("o_orderstatus") == "F").alias("completed"))
    return unfinished(v.raw("customer").select(F.col("c_custkey").alias("sample_id")), samples)


# --- later additions ---------------------------------------------------------------------------

@query(f"SELECT w.range_index, w.bin, w.sample, round(w.value / (s.n / 1e6) / (10 / 1000), 6) AS value FROM ({_W}) w JOIN (WITH {COV} SELECT sample, sum(value)::DOUBLE AS n FROM cov WHERE strand = '*' GROUP BY sample) s USING (sample)")
def normalise_signal_rpkm(v: Views) -> DataFrame:
    found = normalise.normalise_windows(_windows(v, fixed_width=40, bin_size=10), v.sizes(), "rpkm", 10)
    return found.select("range_index", "bin", "sample", F.round("value", 6).alias("value"))


@query(f"WITH {COV}, n AS (SELECT sample, sum(value)::DOUBLE AS n FROM cov WHERE strand = '*' GROUP BY sample) SELECT contig, start, \"end\", sample, round(value / (n / 1e6), 6) AS value FROM cov JOIN n USING (sample) WHERE contig = 'chr2' AND strand = '*' AND \"end\" > 20 AND start < 120")
def region_cpm(v: Views) -> DataFrame:
    cut = signal.region_slice(v.coverage(), v.contigs(), "chr2", 20, 120).withColumn("value", F.col("value").cast("double"))
    return normalise.normalise(cut, v.sizes(), "cpm", ["value"]).select("contig", "start", "end", "sample", F.round("value", 6).alias("value"))


@query(f"WITH {VARIANTS}, p AS (SELECT DISTINCT contig, pos FROM variants), s AS (SELECT DISTINCT sample FROM variants) SELECT p.contig, p.pos, s.sample, coalesce(v.genotype, -1) AS genotype, coalesce(v.ad_ref, 0) AS ad_ref, coalesce(v.ad_alt, 0) AS ad_alt FROM p CROSS JOIN s LEFT JOIN variants v ON v.contig = p.contig AND v.pos = p.pos AND v.sample = s.sample")
def variants_dense(v: Views) -> DataFrame:
    from .schema import FILL

    found = v.variants()
    kinds = found.select(F.col("sample").alias("sample_id")).distinct()
    return sites.dense_sites(found, kinds, FILL).select("contig", "pos", "sample", "genotype", "ad_ref", "ad_alt")


@query(f"WITH {METHYL}, p AS (SELECT DISTINCT contig, pos FROM methyl WHERE contig = 'chr3') SELECT p.contig, p.pos, k.sample, coalesce(m.n_methylated, 0) AS n_methylated, coalesce(m.n_unmethylated, 0) AS n_unmethylated, round(m.methylation_pct, 6) AS methylation_pct FROM p CROSS JOIN kinds k LEFT JOIN methyl m ON m.contig = p.contig AND m.pos = p.pos AND m.sample = k.sample")
def methylation_dense(v: Views) -> DataFrame:
    from .schema import FILL

    found = sites.dense_sites(v.methylation().where("contig = 'chr3'"), v.event_samples(), FILL)
    return found.select("contig", "pos", "sample", "n_methylated", "n_unmethylated", F.round("methylation_pct", 6).alias("methylation_pct"))


@query(f"WITH {MATRIX} SELECT round(sum(x), 6) AS variance FROM (SELECT var_samp(value) AS x FROM matrix GROUP BY feature)")
def pca_total_variance(v: Views) -> DataFrame:
    return stats.pca(v.matrix(), 1_000)[1].agg(F.round(F.sum("explained_variance"), 6).alias("variance"))
