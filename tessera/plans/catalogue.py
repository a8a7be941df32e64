"""The registered queries: every operator family on the driver's tables, with the same
result as SQL text where SQL can express it."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import arrays, images, molecules, named, scoring, text
from tessera.operators import columns, curate, metrics, ordering, records
from tessera.plans import config
from tessera.sources import readers, writers
from tessera.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BACKEND = molecules.Graph()
STOP = "."
LEAST_REWARD = 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{session.shared_folder(spark)}/tables-{uuid.uuid4().hex}"


# --- sources, columns, identifiers -------------------------------------------------

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
    SELECT 'documents' AS source_csv, trim(text, {_WS}) AS text FROM documents WHERE trim(text, {_WS}) <> ''
    UNION ALL SELECT 'benchmark', trim(text, {_WS}) FROM benchmark WHERE trim(text, {_WS}) <> ''""")
def src_union_provenance(spark, d):
    found = {n: table(spark, d, n) for n in ("documents", "benchmark")}
    return readers.merged(found, keep=["text"], molecule=["SMILES", "text"])


@query("SELECT c_custkey, c_name, 'c_name' AS resolved FROM customer")
def col_resolve_first_present(spark, d):
    df = table(spark, d, "customer")
    name = columns.first_present(df, ["C_NAME", "c_name", "c_custkey"])
    return columns.pruned(df, [name, "c_custkey", "absent"]).withColumn("resolved", F.lit(name))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _scratch(spark)
    writers.csv(table(spark, d, "customer"), path)
    back = readers.csv(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def parquet_json_union(spark, d):
    path = _scratch(spark)
    own = table(spark, d, "supplier").select("s_suppkey", "s_name")
    own.write.parquet(f"{path}/a.parquet")
    own.write.json(f"{path}/b.jsonl")
    return readers.by_ending(spark, [f"{path}/a.parquet", f"{path}/b.jsonl"]).select("s_suppkey", "s_name")


@query(r"""
    SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'sample') AS sft_name,
        coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}_.-]', '_', 'g'), '_'), ''), 'sample') AS rl_name,
        CASE WHEN page_id % 2 = 0 THEN (page_id // 2)::VARCHAR ELSE (page_id / 2)::VARCHAR END AS sample_id
    FROM pages""")
def id_resolve_sanitize(spark, d):
    df = table(spark, d, "pages").withColumn("id", F.col("page_id") / 2)
    return df.select("page_id", text.sanitised(F.col("url")).alias("sft_name"), text.sanitised(F.col("url"), "_.-").alias("rl_name"), columns.row_id(df, ["pubchem_cid", "id"], F.col("page_id")).alias("sample_id"))


@query("SELECT doc_id, doc_id AS first_column, doc_id::VARCHAR AS eval_id, lang AS renamed FROM documents")
def table_ids(spark, d):
    df = table(spark, d, "documents").withColumn("image_id", F.col("doc_id").cast("double"))
    ids = columns.table_id(df, columns.IDENTIFIERS["evaluation"])
    return columns.renamed(df, {"lang": "renamed"}).select("doc_id", F.col(columns.first_present(df, ["absent", "doc_id"])).alias("first_column"), ids.alias("eval_id"), "renamed")


@query("SELECT CASE n_regionkey WHEN 0 THEN 1 ELSE 2 END AS place, CASE n_regionkey WHEN 0 THEN 'Train_a.CSV' ELSE 'train_b.csv' END AS name, n_name FROM nation WHERE n_regionkey < 2")
def csv_discovery(spark, d):
    """Files found by name and ending, in their order, with their rows."""
    path, own = _scratch(spark), table(spark, d, "nation")
    for region, name in enumerate(("Train_a.CSV", "train_b.csv", "test_c.csv", "train_d.txt")):
        writers.csv(own.filter(F.col("n_regionkey") == region).select("n_name").coalesce(1), f"{path}/{name}.parts")
        writers.only_file(spark, f"{path}/{name}.parts", f"{path}/{name}")
    # A handful of files, each a table of its own.
    found = [r.path for r in readers.discovered(spark, path, ["train"]).collect()]
    tables = [readers.csv(spark, at).select(F.lit(k).alias("place"), F.lit(at.rsplit("/", 1)[-1]).alias("name"), "n_name") for k, at in enumerate(found, 1)]
    return reduce(DataFrame.unionByName, tables)


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{hashlib.md5(readers.blank_image()).hexdigest()}' ELSE md5(html) END AS digest FROM pages""")
def image_contents(spark, d):
    """Bytes by path, with a white image for what is missing."""
    pages = table(spark, d, "pages")
    named = pages.withColumn("path", F.concat(F.col("page_id").cast("string"), F.lit(".png")))  # pages may share a url, but no file
    files = named.filter("page_id % 3 <> 0").select("path", F.encode("html", "utf-8").alias("content"))
    asked = named.select("page_id", "path")
    return readers.with_contents(asked, "path", files).select("page_id", F.md5(readers.stored_image(F.col("content"))).alias("digest"))


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 1")
def union_of_filled(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), "c_nationkey")
    shards = [customer.filter("c_nationkey = 99"), table(spark, d, "supplier").select("s_suppkey", "s_name"), customer.filter("c_nationkey = 1")]
    return readers.not_empty([x.select("s_suppkey", "s_name") for x in shards])


_MANIFEST_SQL = "SELECT doc_id || CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.jpg' WHEN 'de' THEN '.webp' ELSE '.gif' END AS path FROM documents"


def _manifest(spark, d):
    ending = F.when(F.col("lang") == "en", ".png").when(F.col("lang") == "fr", ".jpg").when(F.col("lang") == "de", ".webp").otherwise(".gif")
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), ending).alias("path"))




@query(f"""
    WITH manifest AS ({_MANIFEST_SQL}), asked AS (SELECT doc_id, doc_id || '.png' AS file_path FROM labels),
    tries AS (SELECT file_path, 0 AS rank, file_path AS path FROM asked
        UNION ALL SELECT file_path, r, regexp_replace(file_path, '\\.[^.]*$', '') || e FROM asked, (VALUES (1, '.png'), (2, '.jpg'), (3, '.jpeg'), (4, '.tif'), (5, '.bmp'), (6, '.webp')) AS x(r, e)),
    found AS (SELECT file_path, arg_min(path, rank) AS resolved FROM tries JOIN manifest USING (path) GROUP BY file_path)
    SELECT doc_id, file_path, resolved, '/data/' || file_path AS full_path FROM asked LEFT JOIN found USING (file_path)""")
def path_resolve_ext(spark, d):
    asked = table(spark, d, "labels").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file_path"))
    out = columns.resolved_files(asked, "file_path", _manifest(spark, d), columns.ENDINGS["rl"])
    return out.withColumn("full_path", columns.full_path(F.col("file_path"), "/data"))


@query(f"WITH manifest AS ({_MANIFEST_SQL}) SELECT doc_id FROM labels WHERE doc_id || '.png' IN (SELECT path FROM manifest)")
def manifest_semi(spark, d):
    asked = table(spark, d, "labels").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file"))
    return columns.existing(asked, "file", _manifest(spark, d)).select("doc_id")


_TRAINING_MANIFEST_SQL = "SELECT 'a/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.TIF' WHEN 4 THEN '.gif' ELSE '.Png' END AS path FROM documents"


@query(f"""
    WITH manifest AS ({_TRAINING_MANIFEST_SQL}), asked AS (SELECT doc_id, 'a/' || doc_id || CASE WHEN quality = 1 THEN '.png' ELSE '.TIF' END AS file_path FROM labels),
    tries AS (SELECT file_path, 0 AS rank, file_path AS path FROM asked
        UNION ALL SELECT file_path, 2 * r + u, regexp_replace(file_path, '\\.[^.]*$', '') || CASE u WHEN 1 THEN upper(e) ELSE e END
        FROM asked, (VALUES (1, '.png'), (2, '.jpg'), (3, '.jpeg'), (4, '.tif'), (5, '.tiff'), (6, '.bmp'), (7, '.webp')) AS x(r, e), (VALUES (0), (1)) AS y(u) WHERE e <> lower(regexp_extract(file_path, '(\\.[^.]*)$', 1))),
    found AS (SELECT file_path, arg_min(path, rank) AS resolved FROM tries JOIN manifest USING (path) GROUP BY file_path)
    SELECT doc_id, file_path, resolved FROM asked LEFT JOIN found USING (file_path)""")
def path_resolve_training(spark, d):
    """A missing file's other endings, but not its own in another case."""
    ending = F.element_at(F.array(*map(F.lit, [".PNG", ".png", ".jpg", ".TIF", ".gif", ".Png"])), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, d, "documents").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), ending).alias("path"))
    asked = table(spark, d, "labels").select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, ".png").otherwise(".TIF")).alias("file_path"))
    return columns.resolved_files(asked, "file_path", files, columns.ENDINGS["training"], skip_own=True).select("doc_id", "file_path", "resolved")


@query(f"""
    WITH manifest AS ({_MANIFEST_SQL}), asked AS (SELECT quality, doc_id || '.png' IN (SELECT path FROM manifest) AS there FROM labels)
    SELECT count_if(there)::BIGINT AS found, count_if(NOT there)::BIGINT AS skipped, count_if(there AND quality = 1)::BIGINT AS good_found, count_if(NOT there AND quality = 1)::BIGINT AS good_skipped,
        count_if(there AND quality = 0)::BIGINT AS bad_found, count_if(NOT there AND quality = 0)::BIGINT AS bad_skipped, count_if(there)::BIGINT AS written FROM asked""")
def filter_counters(spark, d):
    """Found and skipped rows, counted while the found ones are written."""
    path = _scratch(spark)
    asked = table(spark, d, "labels").select("doc_id", "quality", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file"))
    rows, seen = columns.existing_counted(asked, "file", _manifest(spark, d), {"good": F.col("quality") == 1, "bad": F.col("quality") == 0})
    rows.write.parquet(path)
    counts = F.create_map(*[x for k, v in seen.get.items() for x in (F.lit(k), F.lit(v))])
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(*[counts[k].cast("bigint").alias(k) for k in seen.get], "written")


@query(f"WITH manifest AS ({_MANIFEST_SQL}) SELECT doc_id FROM labels WHERE doc_id || '.png' NOT IN (SELECT path FROM manifest)")
def manifest_anti(spark, d):
    asked = table(spark, d, "labels").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file"))
    return columns.missing(asked, "file", _manifest(spark, d)).select("doc_id")


# --- sinks -------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_custkey // 100 AS chunk FROM customer")
def csv_chunks(spark, d):
    """Chunks written twice; each replaces itself."""
    path = _scratch(spark)
    own = table(spark, d, "customer").select("c_custkey", "c_name")
    for k in (0, 0, 1):
        writers.csv_chunk(own.filter(F.floor(F.col("c_custkey") / 100) == k), path, k)
    writers.csv_chunks(own.withColumn("chunk", F.floor(F.col("c_custkey") / 100)), path, "chunk")
    return spark.read.option("header", True).schema("c_custkey bigint, c_name string, chunk bigint").csv(path)


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS batch FROM supplier")
def csv_stream_batches(spark, d):
    """A stream's batches added to a table, the first one replayed, as after a failure."""
    path = _scratch(spark)
    own = table(spark, d, "supplier").select("s_suppkey", "s_name")
    halves = [own.filter(F.col("s_suppkey") % 2 == k) for k in (0, 1)]
    for half in halves:
        half.write.mode("append").parquet(f"{path}/in")
        writers.append_batches(spark.readStream.schema(own.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    writers.csv_batch(halves[0], f"{path}/out", 0)
    return spark.read.option("header", True).schema("s_suppkey bigint, s_name string, batch int").csv(f"{path}/out")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'failed' ELSE 'ok' END AS first, CASE WHEN s_suppkey % 10 = 0 THEN 'failed' ELSE 'skipped_exists' END AS second,
    CASE WHEN s_suppkey % 10 > 0 THEN md5(s_name) END AS grey FROM supplier""")
def images_written_once(spark, d):
    """Names as rows of grey pixels, written as PNGs by the tasks, twice, and read back."""
    path = _scratch(spark)
    tasks = table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.lit(f"{path}/images/"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("image_path"))

    def draw(batch):
        return [images.png(name.encode(), len(name.encode()), 1) if key % 10 else None for key, name in zip(batch["s_suppkey"], batch["s_name"])]

    first = session.materialised(writers.rendered(tasks, tasks.select(F.col("image_path").alias("path")).limit(0), writers.saving(draw)))
    named = F.concat(F.lit(f"{path}/images/"), F.substring_index("path", "/", -1))
    second = session.materialised(writers.rendered(tasks, readers.manifest(spark, f"{path}/images").select(named.alias("path")), writers.saving(draw)))
    back = images.decoded(readers.contents(spark, f"{path}/images"), "content")
    shade = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.hex(F.substring("pixels", 3 * k + 1, F.lit(1)))), "")
    pixels = back.select(named.alias("image_path"), F.md5(F.unhex(shade)).alias("grey"))
    both = first.select("s_suppkey", "image_path", F.col("status").alias("first")).join(second.select("image_path", F.col("status").alias("second")), "image_path")
    return both.join(pixels, "image_path", "left").select("s_suppkey", "first", "second", "grey")


@query("SELECT o_orderkey, o_custkey % 10 = 0 AS held FROM orders")
def split_tables(spark, d):
    path = _scratch(spark)
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 == 0, "val").otherwise("train").alias("part"))
    writers.split_parquet(orders, path)
    train, val = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("train", "val"))
    return train.withColumn("held", F.lit(False)).unionByName(val.withColumn("held", F.lit(True)))


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS name FROM nation")
def json_lines(spark, d):
    path = _scratch(spark)
    writers.json_rows(table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("name")), path)
    return spark.read.schema("n_nationkey int, name string").json(path)


@query("SELECT s_suppkey, 'ok' AS status FROM supplier")
def index_made_once(spark, d):
    path, made = _scratch(spark), []

    def make():
        made.append(1)
        return table(spark, d, "supplier").select("s_suppkey", F.lit("ok" if len(made) == 1 else "again").alias("status"))

    writers.made_once(spark, path, make)
    return writers.made_once(spark, path, make)


@query("""SELECT lang AS name, 'data/' || lang || '.csv' AS csv_path, CASE lang WHEN 'fr' THEN 'pre_rendered' ELSE 'realistic' END AS mode,
    CASE lang WHEN 'en' THEN 100 END AS sample_num, doc_id FROM documents WHERE lang IS NOT NULL AND lang <> 'de'""")
def settings_choose_tables(spark, d):
    """A settings file of one benchmark for each language, written, read and checked; rows of the
    enabled ones that were asked for, with what the file says or leaves to defaults."""
    folder, docs = _scratch(spark), table(spark, d, "documents").select("doc_id", "lang").filter("lang IS NOT NULL")
    # Settings are records of the driver: one for each language, counted before.
    names = sorted(r.lang for r in docs.select("lang").distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError("over 1000 languages")
    extra = {"en": {"sample_num": 100}, "fr": {"mode": "pre_rendered", "image_dir": "img"}}
    given = [{"name": n, "csv_path": f"../data/{n}.csv", "enabled": n != "de"} | extra.get(n, {}) for n in names]
    writers.settings_file(spark, f"{folder}/conf/evaluation.yaml", {"benchmarks": given, "gpu_ids": [0, 1]})
    chosen = config.selected(config.loaded(spark, f"{folder}/conf/evaluation.yaml", config.evaluation).benchmarks, [*names, "unknown"])
    rows = [(b.name, b.csv_path.removeprefix(f"{folder}/"), b.mode, b.sample_num) for b in chosen]
    return docs.withColumnRenamed("lang", "name").join(spark.createDataFrame(rows, "name string, csv_path string, mode string, sample_num int"), "name")


@query("SELECT o_orderkey, '/' || o_orderkey || '.png' AS image, o_orderpriority AS answer, 'Read the molecule.' AS instruction, 'curation-iter2' AS run_name FROM orders WHERE o_totalprice > 100000")
def next_phase_reads(spark, d):
    """What follows a curation: its rows and a settings file are written, and a training reads
    its rows by that file."""
    folder = _scratch(spark)
    kept = table(spark, d, "orders").filter("o_totalprice > 100000")
    writers.csv(kept.select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_path"), F.col("o_orderpriority").alias("smiles")), f"{folder}/curated.csv")
    base = {"instruction": "Read the molecule.", "sft": {"learning_rate": 5e-6, "epochs": 1}, "freeze_layers": [2, 0, 2]}
    writers.settings_file(spark, f"{folder}/next.yaml", writers.next_phase(base, f"{folder}/curated.csv", 2, "/model", folder))
    phase = config.loaded(spark, f"{folder}/next.yaml", config.training)
    (own,) = phase.train_sets
    rows = readers.csv(spark, own.train_csv)
    molecule = columns.first_present(rows, columns.MOLECULE["training"])
    return rows.select(F.col("o_orderkey").cast("bigint"), F.concat(F.lit(own.realistic_image_root), "image_path").alias("image"), F.col(molecule).alias("answer"), F.lit(own.instruction).alias("instruction"), F.lit(phase.trainer["run_name"]).alias("run_name"))


@query("SELECT c_custkey, c_mktsegment AS source_csv FROM customer")
def csv_with_empty_tables(spark, d):
    """Tables by segment and one file without a byte below each other."""
    path, own = _scratch(spark), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    own.write.partitionBy("c_mktsegment").option("header", True).csv(f"{path}/by")
    writers.json_file(spark, f"{path}/none.csv", "")
    # One table for each segment, of which there are few.
    names = [r.c_mktsegment for r in own.select("c_mktsegment").distinct().limit(1000).collect()]
    frames = {n: readers.csv(spark, f"{path}/by/c_mktsegment={n}") for n in names} | {"none": readers.csv(spark, f"{path}/none.csv")}
    return readers.merged(frames).select(F.col("c_custkey").cast("bigint"), "source_csv")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'skipped_exists' WHEN regexp_matches(p_name, '[aeiou][^aeiou ]*$') AND p_size > 10 THEN 'ok' ELSE 'failed' END AS status FROM part""")
def rendered_by_prepared(spark, d):
    """Statuses by a renderer that each task makes once, of what isn't there yet."""
    tasks = table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.concat("p_partkey", F.lit(".png")).alias("image_path"))

    def prepare():
        drawable = re.compile("[aeiou][^aeiou ]*$")
        return lambda batch: [bool(drawable.search(name)) and size > 10 for name, size in zip(batch["p_name"], batch["p_size"])]

    done = tasks.filter("p_size % 5 = 0").select(F.col("image_path").alias("path"))
    return writers.rendered(tasks, done, prepare=prepare).select("p_partkey", "status")


# --- samples, splits, layout -------------------------------------------------------


@query("SELECT doc_id, source FROM documents ORDER BY md5('3407:' || doc_id), doc_id LIMIT 100")
def sample_exact_n(spark, d):
    return ordering.sample(table(spark, d, "documents").select("doc_id", "source"), 100, 3407, "doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def shuffle_head(spark, d):
    return ordering.sample(table(spark, d, "orders").select("o_orderkey"), 500, 42, "o_orderkey")


@query("SELECT c_custkey FROM customer")
def sample_of_all(spark, d):
    return ordering.sample(table(spark, d, "customer").select("c_custkey"), 0, 42, "c_custkey", none_means_all=True)


@query("""SELECT 'shuffled' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'sampled', least(count(*), 100) FROM orders UNION ALL SELECT 'some', least(count(*), 1000) FROM orders UNION ALL SELECT 'all', count(*) FROM orders""")
def training_sizes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    kinds = {
        "shuffled": ordering.training_rows(orders, None, 42, "dynamic", "o_orderkey"),
        "sampled": ordering.training_rows(orders, 100, 42, "dynamic", "o_orderkey"),
        "some": ordering.some_of(orders, 1000, 42, "o_orderkey"),
        "all": ordering.some_of(orders, -1, 42, "o_orderkey"),
    }
    out = None
    for name, df in kinds.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("""
    WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS shuffled, row_number() OVER (ORDER BY doc_id) AS stored FROM documents)
    SELECT 'dynamic' AS kind, shuffled AS place, doc_id FROM t UNION ALL SELECT 'realistic', stored, doc_id FROM t UNION ALL SELECT 'sampled', shuffled, doc_id FROM t WHERE shuffled <= 150""")
def training_order(spark, d):
    """The place that each row has in training, by mode: rows are shuffled only where images are
    made anew or a number is sampled."""
    docs = table(spark, d, "documents").select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    kinds = {"dynamic": (None, "dynamic"), "realistic": (None, "realistic"), "sampled": (150, "realistic")}
    out = None
    for kind, (n, mode) in kinds.items():
        own = ordering.placed(ordering.training_rows(docs, n, 42, mode, "doc_id"), "place").select(F.lit(kind).alias("kind"), (F.col("place") + 1).alias("place"), "doc_id")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 5000")
def first_by_value(spark, d):
    """The first rows by a value, found by counts of its ranges."""
    lines = table(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return ordering.first_rows(lines, 5000, "l_extendedprice", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 64")
def head_slice(spark, d):
    return readers.slice_of(table(spark, d, "documents").select("doc_id", "text"), 64, "doc_id")


@query("""
    WITH n AS (SELECT count(*) AS n, greatest(least(greatest(100, floor(count(*) * 0.02)), count(*) - 1), 0) AS held FROM documents),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, CASE WHEN pos >= n - held THEN 'val' ELSE 'train' END AS part FROM placed, n""")
def train_val_split(spark, d):
    return ordering.split(table(spark, d, "documents").select("doc_id"), 0.02, 100, 42, "doc_id")


@query("""
    WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, ordinal, floor(ordinal / ceil(n / 7.0))::BIGINT AS shard, (ordinal // 512)::BIGINT AS chunk, ordinal % 4 AS robin FROM placed""")
def shard_chunk_round_robin(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    at = F.col("ordinal")
    n = orders.count()
    return ordering.ordinal(orders, "o_orderkey").select("o_orderkey", at, ordering.shard(at, F.lit(n), 7).alias("shard"), ordering.chunk(at, 512).alias("chunk"), ordering.round_robin(at, 4).alias("robin"))


@query("SELECT c_nationkey, count(*) AS n, (sum(count(*)) OVER (ORDER BY c_nationkey) - count(*))::BIGINT AS first FROM customer GROUP BY c_nationkey")
def global_offset(spark, d):
    return ordering.offsets(table(spark, d, "customer"), "c_nationkey")


@query("""
    WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN quality = 1 THEN doc_id END AS v, count(*) OVER () AS n FROM documents LEFT JOIN labels USING (doc_id)),
    every AS (SELECT doc_id, pos, v, true AS own FROM placed UNION ALL SELECT doc_id, pos + n, v, false FROM placed WHERE pos < 8),
    seen AS (SELECT doc_id, own, first_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS r FROM every)
    SELECT doc_id, coalesce(r, -1) AS replacement FROM seen WHERE own""")
def next_valid_circular(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    placed = ordering.ordinal(rows, "doc_id")
    return ordering.next_valid(placed, "ordinal", F.when(F.col("quality") == 1, F.col("doc_id")), placed.count(), 8, -1).select("doc_id", "replacement")


@query("""
    WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, CASE WHEN quality = 1 THEN doc_id END AS v, count(*) OVER () AS n FROM documents LEFT JOIN labels USING (doc_id)),
    asked AS (SELECT doc_id, k, ('0x' || substr(md5('7:' || doc_id || ':' || k), 1, 8))::BIGINT % n AS ordinal FROM placed, range(0, 20) AS x(k) WHERE v IS NULL),
    found AS (SELECT asked.doc_id, arg_min(v, k) AS d FROM asked JOIN placed USING (ordinal) WHERE v IS NOT NULL GROUP BY asked.doc_id)
    SELECT doc_id, coalesce(v, d) AS replacement FROM placed LEFT JOIN found USING (doc_id)""")
def random_replacement(spark, d):
    """Few rows are valid here, so some draw none; a training would stop there (``strict``)."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    placed = ordering.ordinal(rows, "doc_id")
    return ordering.random_replacement(placed, "doc_id", F.when(F.col("quality") == 1, F.col("doc_id")), 7, strict=False).select("doc_id", "replacement")


# --- joins -------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(quality::VARCHAR, '') AS pred FROM documents LEFT JOIN labels USING (doc_id)")
def realign_missing_predictions(spark, d):
    outputs = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("pred"))
    return metrics.realigned(table(spark, d, "documents").select("doc_id"), outputs, "doc_id", "pred")


@query("SELECT coalesce(n_nationkey, r_regionkey) AS key, coalesce(r_name, n_name) AS value FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def override_merge(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return metrics.merged_overrides(base, table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")))


@query("SELECT n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def results_of_all(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    found = nation.join(customer, nation["n_nationkey"] == customer["c_nationkey"], "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n"))
    return metrics.results_of_all(nation.select(F.col("n_name").alias("name")), found)


@query("""
    WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal FROM supplier), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name DESC, s_suppkey) - 1 AS ordinal FROM supplier)
    SELECT ordinal, s_suppkey, s_name FROM a JOIN b USING (ordinal)""")
def paired_by_place(spark, d):
    supplier = table(spark, d, "supplier")
    left = ordering.ordinal(supplier.select("s_suppkey"), "s_suppkey")
    right = ordering.ordinal(supplier.select("s_name", "s_suppkey"), F.desc("s_name"), "s_suppkey").drop("s_suppkey")
    return metrics.paired(left, right).select("ordinal", "s_suppkey", "s_name")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey")
def surviving_rows(spark, d):
    rows = metrics.surviving(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", F.col("l_quantity") > 10)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""
    WITH b AS (SELECT n_nationkey AS key, n_name AS value, n_nationkey AS place FROM nation), o AS (SELECT r_regionkey * 10 AS key, r_name AS value, r_regionkey AS place FROM region)
    SELECT coalesce(b.key, o.key) AS key, coalesce(o.value, b.value) AS value, row_number() OVER (ORDER BY b.key IS NULL, coalesce(b.place, o.place)) AS line FROM b FULL JOIN o ON b.key = o.key""")
def override_order(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("at"))
    over = table(spark, d, "region").select((F.col("r_regionkey") * 10).alias("key"), F.col("r_name").alias("value"), F.col("r_regionkey").alias("at"))
    # A command line has few arguments.
    return metrics.merged_overrides(base, over, order="at").select("key", "value", F.row_number().over(Window.orderBy("place")).cast("bigint").alias("line"))


# --- text --------------------------------------------------------------------------

_EVAL_SQL = f"trim(CASE WHEN suffix(trim(text, {_WS}), '{STOP}') THEN left(trim(text, {_WS}), length(trim(text, {_WS})) - {len(STOP)}) ELSE trim(text, {_WS}) END, {_WS})"


@query(f"SELECT conv_id, turn, {_EVAL_SQL} AS candidate FROM conversations")
def extract_candidate_eval(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.candidate_whole(F.col("text"), STOP).alias("candidate"))


_REFT_SQL = f"replace(trim(split_part({_EVAL_SQL}, chr(10), 1), {_WS}), ' ', '')"


@query(f"SELECT conv_id, turn, {_REFT_SQL} AS candidate FROM conversations")
def extract_candidate_reft(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.candidate_first_line(F.col("text"), STOP).alias("candidate"))


@query(rf"""
    SELECT conv_id, turn, coalesce(replace(list_filter(list_transform(string_split_regex(trim(text, {_WS}), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x, {_WS})), lambda x: x <> '')[1], ' ', ''), '') AS candidate
    FROM conversations""")
def extract_candidate_rl(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.candidate_first_text(F.col("text")).alias("candidate"))


@query("""
    SELECT item_id, i AS line_no, substr(text, i * 38 + 1, 38) AS line
    FROM (SELECT item_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 38 + 1)) AS i FROM benchmark)""")
def wrap_38(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(text.wrapped(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("""SELECT page_id, regexp_extract(url, '^(.*/)?[^/]*$', 1) || regexp_extract(url, '([^/]*?)(?:\\.[^./]*)?$', 1) || '_plain' AS folder, split_part(url, ' ', 1) AS first_output FROM pages""")
def output_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.export_folder(F.col("url"), "plain").alias("folder"), text.before_space(F.col("url")).alias("first_output"))


def _draw_sql(k: int) -> str:
    return f"(('0x' || substr(md5('5:' || p_partkey || ':{k}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _formula_sql() -> str:
    parts, going = [], "true"
    digit = lambda k: f"(floor({_draw_sql(k)} * 8) + 2)::BIGINT"
    for i in range(4):
        symbol = f"{images.SYMBOLS}[(floor({_draw_sql(10 * i + 1)} * 9) + 1)::BIGINT]"
        part = f"CASE WHEN {_draw_sql(10 * i + 2)} < 0.25 THEN '(' || {symbol} || {digit(10 * i + 3)} || ')' ELSE {symbol} END || CASE WHEN {_draw_sql(10 * i + 4)} < 0.3 THEN {digit(10 * i + 5)}::VARCHAR ELSE '' END"
        going = going if i == 0 else f"{going} AND {_draw_sql(10 * i)} >= 0.7"
        parts.append(f"CASE WHEN {going} THEN {part} ELSE '' END")
    return " || ".join(parts)


@query(f"SELECT p_partkey, {_formula_sql()} AS formula FROM part")
def condensed_formulas(spark, d):
    return table(spark, d, "part").select("p_partkey", images.condensed_formula(5, F.col("p_partkey")).alias("formula"))


@query(f"SELECT p_partkey, {_draw_sql(1)} < 0.2 AS blurred, {_draw_sql(2)} < 0.3 AS rotated, p_name AS label, p_brand AS held_label FROM part")
def style_draws(spark, d):
    key, style = F.col("p_partkey"), images.Style()
    names = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", (images.draw(5, key, 1) < style.blur).alias("blurred"), (images.draw(5, key, 2) < style.rotate).alias("rotated"), images.chosen_label(*names, training=True).alias("label"), images.chosen_label(*names, training=False).alias("held_label"))


@query("SELECT item_id, octet_length(encode(text))::INTEGER AS width, 1 AS height, md5(text) AS grey, 3 * octet_length(encode(text)) AS n_bytes FROM benchmark")
def image_round_trip(spark, d):
    """Texts as rows of grey pixels, stored as PNGs and decoded."""
    df = table(spark, d, "benchmark").select("item_id", F.encode("text", "utf-8").alias("grey"), F.octet_length("text").alias("w"), F.lit(1).alias("h"))
    held = images.encoded(df, "grey", "w", "h").select("item_id", readers.stored_image(F.col("image")).alias("image"))
    back = images.decoded(held, "image")
    shade = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.hex(F.substring("pixels", 3 * k + 1, F.lit(1)))), "")
    return back.select("item_id", "width", "height", F.md5(F.unhex(shade)).alias("grey"), F.octet_length("pixels").alias("n_bytes"))


@query("""SELECT item_id, 32 AS width, ((octet_length(encode(text)) + 31) // 32)::INTEGER AS height,
    md5(regexp_replace(rpad(hex(encode(text)), ((octet_length(encode(text)) + 31) // 32 * 64)::INTEGER, '0'), '(.).', '\\1', 'g')) AS shades FROM benchmark WHERE text <> ''""")
def jpeg_round_trip(spark, d):
    """Texts as images of 16 shades, stored as JPEGs and decoded: each pixel keeps its shade."""
    n = F.ceil(F.octet_length("text") / 32)
    shades = F.transform(F.sequence(F.lit(1), F.col("h0") * 64, F.lit(2)), lambda k: F.concat(F.substring("h", k, F.lit(1)), F.lit("8")))
    df = table(spark, d, "benchmark").filter("text <> ''").select("item_id", n.cast("int").alias("h0"), F.rpad(F.hex(F.encode("text", "utf-8")), (n * 64).cast("int"), "0").alias("h"))
    drawn = df.select("item_id", F.unhex(F.array_join(shades, "")).alias("grey"), F.lit(32).alias("w"), F.col("h0").alias("h"))
    held = images.encoded(drawn, "grey", "w", "h", lossy=True).select("item_id", "image")
    back = images.decoded(held, "image").withColumn("x", F.hex("pixels"))
    shade = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda k: F.substring("x", 6 * k + 1, F.lit(1))), "")
    return back.select("item_id", "width", "height", F.md5(shade).alias("shades"))


def _penalty_sql(relation: str, key: str, column: str) -> str:
    """Penalty by key: character runs by a window, leading units by list functions."""
    unit = lambda p: f"coalesce(nullif(list_position(list_transform(range(0, n // {p}), lambda i: substr(s, (i * {p} + 1)::BIGINT, {p}) = substr(s, 1, {p})), false), 0) - 1, n // {p})"
    units = " ".join(f"WHEN n >= {12 * p} AND u{p} >= 12 THEN least(1.0::DOUBLE, (u{p} * {p})::DOUBLE / n)" for p in range(1, 5))
    return f"""
    WITH t AS (SELECT {key}, {column} AS s, length({column}) AS n FROM {relation}),
    c AS (SELECT {key}, unnest(range(1, n + 1)) AS i, unnest(string_split(s, '')) AS ch FROM t WHERE n > 0),
    g AS (SELECT {key}, ch, i - row_number() OVER (PARTITION BY {key}, ch ORDER BY i) AS run FROM c),
    r AS (SELECT {key}, max(m) AS longest, count(DISTINCT ch) AS kinds FROM (SELECT {key}, ch, count(*) AS m FROM g GROUP BY {key}, ch, run) GROUP BY {key}),
    u AS (SELECT {key}, s, n, {', '.join(f'{unit(p)} AS u{p}' for p in range(1, 5))} FROM t)
    SELECT {key}, CASE WHEN n < 20 THEN 0.0::DOUBLE {units}
        WHEN longest::DOUBLE / n > 0.3 THEN longest::DOUBLE / n WHEN n > 30 AND kinds <= 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS penalty
    FROM u LEFT JOIN r USING ({key})"""


@query(_penalty_sql("conversations", "conv_id, turn", "text"))
def repetition_penalty(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scoring.repetition_penalty(F.col("text")).alias("penalty"))


@query("""
    SELECT item_id, list_transform(range(0, len(parts)), lambda i: CASE WHEN parts[i + 1] = '<image>' THEN 'image' ELSE 'text' END).list_aggregate('string_agg', '|') AS kinds, len(parts)::INTEGER AS n_parts, array_to_string(parts, '~') AS parts
    FROM (SELECT item_id, ['<image>', text] AS parts FROM benchmark)""")
def prompt_parts(spark, d):
    df = table(spark, d, "benchmark").withColumn("p", text.content_parts(F.concat(F.lit("<image>"), F.col("text"))))
    shown = F.transform("p", lambda x: F.coalesce(x["text"], F.lit("<image>")))
    return df.select("item_id", F.array_join(F.transform("p", lambda x: x["type"]), "|").alias("kinds"), F.size("p").alias("n_parts"), F.array_join(shown, "~").alias("parts"))


@query(f"""
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim('<image>' || text, {_WS}) ELSE '<image>' || chr(10) || ' Give me the SMILES of the molecule. ' END AS prompt FROM conversations""")
def plain_prompt(spark, d):
    content = F.when(F.col("role") == "user", F.concat(F.lit("<image>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.plain_prompt(text.content_parts(content)).alias("prompt"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN event_type WHEN 'error' THEN '' ELSE event_type || user_id END AS truth FROM events""")
def ground_truth_unwrap(spark, d):
    record = F.when(F.col("event_type") == "click", F.col("event_type")).when(F.col("event_type") == "error", F.col("props")).otherwise(F.to_json(F.struct(F.concat("event_type", F.col("user_id").cast("string")).alias("ground_truth"))))
    return table(spark, d, "events").select("event_id", text.ground_truth(record).alias("truth"))


# --- rewards and curation ----------------------------------------------------------


def _replies(spark, d):
    """Assistant turns; the gold is the conversation's first user turn."""
    conv = table(spark, d, "conversations")
    gold = conv.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("gold"))
    replies = conv.filter("role = 'assistant'").join(gold, "conv_id").select("conv_id", "turn", "gold", "text")
    # Up to 64 turns of one gold stay together, so that it is described once; more are further tasks' work.
    return session.spread(replies, "conv_id", F.floor(F.col("turn") / 64), rows=conv.filter("role = 'assistant'").count())


# Texts spell molecules: each word is an atom of a chain, by its length, and the chain's
# middle becomes a carbon with fluorine in every other conversation. Such molecules are equal if
# and only if their chains are, read either way, which SQL can tell without any chemistry.


def _atoms(c):
    return F.array_join(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.substring(F.lit("CONS"), F.length(w) % 4 + 1, F.lit(1))), "")


def _chain(c, conv):
    """(left, mark, right) of a text: the chain's sides and its middle."""
    at = F.floor(F.length(c) / 2).cast("int")
    split = (F.length(c) >= 3) & (conv % 2 == 0)
    return F.struct(F.when(split, F.substring(c, F.lit(1), at)).otherwise(c).alias("left"), F.when(split, "[C@@H](F)").otherwise("").alias("mark"), F.when(split, F.substring(c, at + 2, F.length(c))).otherwise("").alias("right"))


def _spelled(x):
    return F.concat(x["left"], x["mark"], x["right"])


def _completions(spark, d):
    """Assistant turns that spell the gold from its other end, its mirror image, another molecule, an
    open ring or a wrong valence."""
    own = _replies(spark, d).withColumn("g", _chain(_atoms(F.col("gold")), F.col("conv_id"))).withColumn("p", _chain(_atoms(F.col("text")), F.col("conv_id")))
    mirror = F.replace(F.col("g.mark"), F.lit("@@"), F.lit("@"))
    kinds = [F.concat(F.reverse("g.right"), mirror, F.reverse("g.left")), F.concat("g.left", mirror, "g.right"), _spelled(F.col("p")), F.concat(_spelled(F.col("g")), F.lit("1")), F.concat(_spelled(F.col("g")), F.lit("CFC"))]
    said = F.element_at(F.array(*kinds), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return own.select("conv_id", "turn", _spelled(F.col("g")).alias("gold"), F.concat(F.lit(" "), said, F.lit("\n")).alias("text"))


def _scored(spark, d, weights, clamp):
    return curate.scored(_completions(spark, d), "gold", "text", BACKEND, weights, clamp, unannotated=0.5, stop=STOP)


def _atoms_sql(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda w: substr('CONS', (length(w) % 4 + 1)::BIGINT, 1)), '')"


def _chain_sql(atoms: str) -> str:
    """Columns l, m and r of a relation with an atoms column and conv_id."""
    split = f"(length({atoms}) >= 3 AND conv_id % 2 = 0)"
    return f"CASE WHEN {split} THEN substr({atoms}, 1, length({atoms}) // 2) ELSE {atoms} END AS l, CASE WHEN {split} THEN '[C@@H](F)' ELSE '' END AS m, CASE WHEN {split} THEN substr({atoms}, length({atoms}) // 2 + 2) ELSE '' END AS r"


def _key_sql(x: str) -> str:
    """One string for a chain however it is read: its middle has a hand where its sides differ."""
    x = f"{x}."
    return f"""CASE WHEN {x}m = '' THEN least({x}l, reverse({x}l)) WHEN reverse({x}l) = {x}r THEN {x}l || 'f' || {x}r
        ELSE least({x}l || (CASE WHEN contains({x}m, '@@') THEN 'a' ELSE 'b' END) || {x}r, reverse({x}r) || (CASE WHEN contains({x}m, '@@') THEN 'b' ELSE 'a' END) || reverse({x}l)) END"""


_COMPLETIONS_SQL = f"""
    golds AS (SELECT conv_id, {_chain_sql('atoms')} FROM (SELECT conv_id, {_atoms_sql("arg_min(text, turn)")} AS atoms FROM conversations WHERE role = 'user' GROUP BY conv_id)),
    own AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS kind, {_chain_sql('atoms')} FROM (SELECT conv_id, turn, {_atoms_sql("text")} AS atoms FROM conversations WHERE role = 'assistant')),
    matched AS (SELECT o.conv_id, o.turn, kind, g.l || g.m || g.r AS gold, {_key_sql('g')} AS gold_key, {_key_sql('o')} AS own_key, g.m <> '' AND reverse(g.l) <> g.r AS handed,
        g.l AS gl, g.m <> '' AS gm, g.r AS gr, o.l AS ol, o.m <> '' AS om, o.r AS r,
        CASE kind WHEN 0 THEN reverse(g.r) || replace(g.m, '@@', '@') || reverse(g.l) WHEN 1 THEN g.l || replace(g.m, '@@', '@') || g.r WHEN 2 THEN o.l || o.m || o.r WHEN 3 THEN g.l || g.m || g.r || '1' ELSE g.l || g.m || g.r || 'CFC' END AS pred
        FROM own o JOIN golds g USING (conv_id)),
    completions AS (SELECT conv_id, turn, pred, gold_key, own_key, handed, kind, gold <> '' AS gold_valid, kind < 3 AND pred <> '' AS pred_valid, gl, gm, gr,
        CASE WHEN kind = 2 THEN ol ELSE gl END AS pl, CASE WHEN kind = 2 THEN om ELSE gm END AS pm, CASE WHEN kind = 2 THEN r ELSE gr END AS pr FROM matched),
    chains AS (SELECT gl AS l, gm AS m, gr AS r FROM completions UNION SELECT pl, pm, pr FROM completions),
    straight AS (SELECT l, m, r, CASE WHEN m THEN l || 'C' || r ELSE l END AS c FROM chains),
    walks AS (
        SELECT l, m, r, substr(c, i, k) AS w, length(c) - i + 1 >= k AS fits FROM (SELECT *, unnest(range(1, length(c))) AS i FROM straight), range(2, 9) AS s(k)
        UNION ALL SELECT l, m, r, 'F' || substr('C' || r, 1, k), length(r) + 1 >= k FROM straight, range(1, 8) AS s(k) WHERE m
        UNION ALL SELECT l, m, r, 'F' || substr('C' || reverse(l), 1, k), length(l) + 1 >= k FROM straight, range(1, 8) AS s(k) WHERE m),
    digests AS (SELECT l, m, r, md5(least(w, reverse(w))) AS h FROM (SELECT DISTINCT l, m, r, array_to_string(string_split(w, ''), '-') AS w FROM walks WHERE fits)),
    prints AS (SELECT l, m, r, list(DISTINCT b) AS bits FROM (SELECT l, m, r, unnest([('0x' || substr(h, 1, 4))::INTEGER % 2048, ('0x' || substr(h, 5, 4))::INTEGER % 2048]) AS b FROM digests) GROUP BY l, m, r),
    alike AS (SELECT c.*, coalesce(g.bits, []::INTEGER[]) AS gb, coalesce(p.bits, []::INTEGER[]) AS pb FROM completions c
        LEFT JOIN prints g ON c.gl = g.l AND c.gm = g.m AND c.gr = g.r LEFT JOIN prints p ON c.pl = p.l AND c.pm = p.m AND c.pr = p.r),
    compared AS (SELECT *, CASE WHEN NOT gold_valid OR NOT pred_valid THEN 0.0::DOUBLE WHEN len(gb) + len(pb) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(gb, pb))::DOUBLE / len(list_distinct(list_concat(gb, pb))) END AS near,
        gold_valid AND pred_valid AND CASE kind WHEN 0 THEN true WHEN 1 THEN NOT handed ELSE gold_key = own_key END AS same FROM alike),
    parts AS (SELECT conv_id, turn, pred, pred_valid::INTEGER::DOUBLE AS validity, near AS tanimoto, same::INTEGER::DOUBLE AS canonical, near AS graph,
        CASE WHEN gold_valid AND handed THEN same::INTEGER::DOUBLE ELSE 0.5::DOUBLE END AS chiral FROM compared)"""

_REWARD_SQL = "({v}::DOUBLE * validity + {t}::DOUBLE * tanimoto + {c}::DOUBLE * canonical + {g}::DOUBLE * graph + {h}::DOUBLE * chiral - {r}::DOUBLE * penalty) / {s}::DOUBLE"
_RL_SQL = _REWARD_SQL.format(v=0.5, t=2, c=3, g=2, h=1, r=2, s=8.5)
_CURATION_SQL = _REWARD_SQL.format(v=0, t=1, c=8, g=2, h=1, r=2, s=12)


_SCORED_SQL = f"WITH {_COMPLETIONS_SQL}, penalties AS ({_penalty_sql('completions', 'conv_id, turn', 'pred')}), scored AS (SELECT * FROM parts JOIN penalties USING (conv_id, turn))"


@query(f"{_SCORED_SQL} SELECT conv_id, turn, validity, tanimoto, canonical, graph, chiral, penalty AS repetition FROM scored")
def reward_components(spark, d):
    return _scored(spark, d, scoring.RL_WEIGHTS, True).select("conv_id", "turn", "validity", "tanimoto", "canonical", "graph", "chiral", "repetition")


@query(f"{_SCORED_SQL} SELECT conv_id, turn, pred, greatest(0.0::DOUBLE, {_RL_SQL}) AS reward FROM scored")
def reward_rl(spark, d):
    return _scored(spark, d, scoring.RL_WEIGHTS, True).select("conv_id", "turn", "pred", "reward")


@query(f"{_SCORED_SQL} SELECT conv_id, turn, greatest(0.0::DOUBLE, {_RL_SQL}) AS score FROM scored")
def compute_score(spark, d):
    """The trainer's reward function on records as it gets them."""
    truth = F.to_json(F.struct(F.lit("rule").alias("style"), F.col("gold").alias("ground_truth")))
    score = curate.compute_score(F.lit("conversations"), F.col("text"), truth, backend=BACKEND, unannotated=0.5)
    return _completions(spark, d).select("conv_id", "turn", score.alias("score"))


@query(ORACLE_SQL["compute_score"])
def compute_score_by_name(spark, d):
    """The same called from SQL text."""
    named.register(spark, unannotated=0.5)
    rows = _completions(spark, d).withColumn("truth", F.to_json(F.struct(F.lit("rule").alias("style"), F.col("gold").alias("ground_truth"))))
    return spark.sql("SELECT conv_id, turn, compute_score('conversations', text, truth) AS score FROM {rows}", rows=rows)


@query(f"{_SCORED_SQL} SELECT conv_id, turn, 0.0::DOUBLE AS reward FROM scored")
def reward_without_weights(spark, d):
    return _scored(spark, d, scoring.Weights(0, 0, 0, 0, 0, 1), True).select("conv_id", "turn", "reward")


@query(f"{_SCORED_SQL} SELECT conv_id, turn, pred, {_CURATION_SQL} AS reward FROM scored")
def reward_reft(spark, d):
    return _scored(spark, d, scoring.CURATION_WEIGHTS, False).select("conv_id", "turn", "pred", "reward")


@query(f"""
    WITH golds AS (SELECT conv_id, arg_min(text, turn) AS gold FROM conversations WHERE role = 'user' GROUP BY conv_id),
    completions AS (SELECT conv_id, turn, gold, {_REFT_SQL} AS pred FROM conversations JOIN golds USING (conv_id) WHERE role = 'assistant'),
    plain AS (SELECT conv_id, turn, replace(trim(translate(gold, '/\\', ''), {_WS}), ' ', '') AS g, replace(trim(translate(pred, '/\\', ''), {_WS}), ' ', '') AS p FROM completions),
    grams AS (SELECT *, {', '.join(f"list_distinct(list_transform(range(0, greatest(length({e}) - 3, 0) + 1), lambda i: substr({e}, (i + 1)::BIGINT, 3))) AS {n}" for n, e in (('gg', 'g'), ('pg', 'p')))} FROM plain)
    SELECT conv_id, turn, len(list_intersect(gg, pg))::INTEGER AS shared, len(list_distinct(list_concat(gg, pg)))::INTEGER AS either FROM grams""")
def tanimoto_sets(spark, d):
    plain = lambda c: F.translate(text.strip(text.without_geometry(c)), " ", "")
    g, p = (scoring.character_grams(plain(c)) for c in (F.col("gold"), text.candidate_first_line(F.col("text"), STOP)))
    sizes = text.bound(F.struct(g.alias("g"), p.alias("p")), lambda x: F.struct(F.size(F.array_intersect(x["g"], x["p"])).alias("shared"), F.size(F.array_union(x["g"], x["p"])).alias("either")))
    return _replies(spark, d).select("conv_id", "turn", sizes.alias("x")).select("conv_id", "turn", "x.*")


@query(f"WITH {_COMPLETIONS_SQL} SELECT round(avg(validity), 9) AS success, round(avg(tanimoto), 9) AS tanimoto FROM parts")
def canonical_success(spark, d):
    rows = _completions(spark, d).select(BACKEND.described(F.col("gold")).alias("g"), BACKEND.described(text.candidate_first_line(F.col("text"), STOP)).alias("p"))
    return rows.agg(F.round(metrics.success_rate(F.col("p.valid")), 9).alias("success"), F.round(F.avg(scoring.tanimoto(F.col("g.fingerprint"), F.col("p.fingerprint"))), 9).alias("tanimoto"))


@query(f"""
    WITH chains AS (SELECT conv_id, turn, {_chain_sql('atoms')} FROM (SELECT conv_id, turn, {_atoms_sql("text")} AS atoms FROM conversations)),
    keys AS (SELECT conv_id, turn, turn % 4 = 3 OR l = '' AS invalid, CASE WHEN turn % 4 = 3 THEN 'open ' || l || m || r ELSE {_key_sql('chains')} END AS k FROM chains)
    SELECT conv_id, turn, count(*) OVER (PARTITION BY k) AS alike, invalid AS nothing FROM keys""")
def canonical_forms(spark, d):
    """What stands for an invalid string: itself in evaluation, nothing in rewards."""
    given = F.concat(_spelled(F.col("x")), F.when(F.col("turn") % 4 == 3, "(").otherwise(""))
    rows = session.spread(table(spark, d, "conversations")).withColumn("x", _chain(_atoms(F.col("text")), F.col("conv_id")))
    forms = session.materialised(rows.select("conv_id", "turn", BACKEND.canonical(given).alias("x")).select("conv_id", "turn", molecules.canonical_for_evaluation(F.col("x")).alias("form"), (molecules.canonical_for_reward(F.col("x")) == text.EMPTY).alias("nothing")))
    return forms.join(forms.groupBy("form").agg(F.count("*").alias("alike")), "form").select("conv_id", "turn", "alike", "nothing")


_DIGITS_SQL = " || ".join(f"(p_partkey // {3**k} % 3)" for k in range(6))
_TURNS_SQL = ", ".join(f"substr({x}, {k + 1}) || substr({x}, 1, {k})" for k in range(6) for x in ("w", "reverse(w)"))


@query(f"""
    WITH rings AS (SELECT p_partkey, {_DIGITS_SQL} AS w FROM part), keys AS (SELECT p_partkey, least({_TURNS_SQL}) AS k FROM rings)
    SELECT p_partkey, true AS same, min(p_partkey) OVER (PARTITION BY k) AS first FROM keys""")
def ring_spellings(spark, d):
    """Six places of a benzene ring with fluorine, chlorine or nothing: written as aromatic, and with double bonds
    from another place in the other direction. Rings are equal if turned or turned over."""
    groups = F.array(F.lit(""), F.lit("(F)"), F.lit("(Cl)"))
    at = [F.element_at(groups, (F.floor(F.col("p_partkey") / 3**k) % 3 + 1).cast("int")) for k in range(6)]
    held = F.array(*at)
    turned = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.element_at(held, ((F.col("p_partkey") + 5 - k) % 6 + 1).cast("int")))
    aromatic = F.concat(F.lit("c1"), at[0], *[x for a in at[1:5] for x in (F.lit("c"), a)], F.lit("c1"), at[5])
    kekule = F.concat(F.lit("C1"), turned[0], *[x for k in range(1, 5) for x in (F.lit("=C" if k % 2 else "C"), turned[k])], F.lit("=C1"), turned[5])
    forms = session.spread(table(spark, d, "part")).select("p_partkey", BACKEND.canonical(aromatic)["canonical"].alias("a"), BACKEND.canonical(kekule)["canonical"].alias("b"))
    return forms.join(forms.groupBy("a").agg(F.min("p_partkey").alias("first")), "a").select("p_partkey", (F.col("a") == F.col("b")).alias("same"), "first")


_LABELS = {"[Ph]": "*", "[13CH3-]": "[13CH3-]", "[R]": "*", "[N+]": "[N+]", "[OMe]": "*", "[nH]": "[nH]", "[C@@H]": "[C@@H]", "[Xx2]": "*"}


@query(f"SELECT p_partkey, 'CC(=O)[' || p_size || '*]' || {list(_LABELS.values())}[p_partkey % {len(_LABELS)} + 1] || '[NH2]Cl' AS form FROM part")
def group_labels(spark, d):
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    given = F.concat(F.lit("C/C(=O)[R"), F.col("p_size").cast("string"), F.lit("]\\"), label, F.lit("[NH2]Cl"))
    return table(spark, d, "part").select("p_partkey", molecules.for_evaluation(given).alias("form"))


_BEST_SQL = f"{_SCORED_SQL}, ranked AS (SELECT conv_id, turn, pred, {_CURATION_SQL} AS reward FROM scored), best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY reward DESC, turn) = 1)"


def _best(spark, d):
    rows = _scored(spark, d, scoring.CURATION_WEIGHTS, False).select("conv_id", "turn", "pred", "reward")
    return curate.best(rows, ["conv_id"], F.col("turn"), ["turn", "pred"])


@query(f"{_BEST_SQL} SELECT conv_id, turn, pred, round(reward, 6) AS reward FROM best WHERE reward >= {LEAST_REWARD} AND pred <> ''")
def curate_best_of_n(spark, d):
    return curate.accepted(_best(spark, d), LEAST_REWARD)


@query(f"""{_BEST_SQL} SELECT count(*) AS total, count_if(reward >= {LEAST_REWARD} AND pred <> '')::BIGINT AS kept, count_if(reward < {LEAST_REWARD})::BIGINT AS below_threshold,
    count_if(reward >= {LEAST_REWARD} AND pred = '')::BIGINT AS empty, round(avg(reward) FILTER (WHERE reward >= {LEAST_REWARD} AND pred <> ''), 9) AS mean_reward FROM best""")
def curation_funnel(spark, d):
    return curate.funnel(_best(spark, d), LEAST_REWARD).withColumn("mean_reward", F.round("mean_reward", 9))


_TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS reward FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice * (1 - l_discount) DESC, {', '.join(_TIES)}) = 1""")
def best_of_n_scale(spark, d):
    rows = table(spark, d, "lineitem").withColumn("reward", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return curate.best(rows, ["l_orderkey", "l_linenumber"], F.struct(*_TIES), ["l_partkey", "l_suppkey"])


# --- metrics -----------------------------------------------------------------------

_PAIRS_SQL = """pairs AS (SELECT lang, CASE WHEN toxic = 1 THEN quality || '@' ELSE quality::VARCHAR END AS gold, CASE WHEN quality IS NULL THEN '' WHEN n_chars > 2000 THEN quality || '@' ELSE quality::VARCHAR END AS pred,
    FROM documents LEFT JOIN labels USING (doc_id)), compared AS (SELECT lang, coalesce(nullif(gold, ''), '<empty>') AS gold, pred FROM pairs)"""
_METRICS_SQL = """round(avg((gold = pred)::INTEGER), 9) AS canon_smiles, round(avg((replace(gold, '@', '') = replace(pred, '@', ''))::INTEGER), 9) AS graph,
    round(coalesce(avg((gold = pred)::INTEGER) FILTER (WHERE contains(gold, '@')), -1.0), 9) AS chiral, round(avg((gold = pred)::INTEGER), 9) AS accuracy, count(*) AS num_samples FROM compared"""


def _metrics(spark, d, groups):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    q = F.col("quality").cast("string")
    pairs = docs.select("lang", F.when(F.col("toxic") == 1, F.concat(q, F.lit("@"))).otherwise(q).alias("gold"), F.when(q.isNull(), "").when(F.col("n_chars") > 2000, F.concat(q, F.lit("@"))).otherwise(q).alias("pred"))
    g, p = F.col("gold"), F.col("pred")
    out = metrics.benchmark_metrics(pairs, groups, g, p, F.translate(g, "@", ""), F.translate(p, "@", ""))
    return out.select(*groups, *[F.round(c, 9).alias(c) for c in ("canon_smiles", "graph", "chiral", "accuracy")], "num_samples")


@query(f"WITH {_PAIRS_SQL} SELECT lang, {_METRICS_SQL} GROUP BY lang")
def benchmark_metrics(spark, d):
    return _metrics(spark, d, ["lang"])


@query(f"WITH {_PAIRS_SQL}, m AS (SELECT {_METRICS_SQL}) UNPIVOT m ON canon_smiles, graph, chiral, accuracy INTO NAME metric VALUE value")
def metrics_summary(spark, d):
    return _metrics(spark, d, []).unpivot(["num_samples"], ["canon_smiles", "graph", "chiral", "accuracy"], "metric", "value")


@query("SELECT lang, round(avg((quality = toxic)::INTEGER), 9) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def training_accuracy(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    accuracy = metrics.training_accuracy(F.col("quality").cast("string"), F.col("toxic").cast("string"), F.col("quality").isNotNull())
    return docs.groupBy("lang").agg(F.round(accuracy, 9).alias("accuracy"))


@query("SELECT event_type, count(*) AS total, count_if(value > 50)::BIGINT AS ok, count_if(value <= 50)::BIGINT AS failed FROM events GROUP BY event_type")
def status_counts(spark, d):
    return metrics.counts_by(table(spark, d, "events"), "event_type", ok=F.col("value") > 50, failed=F.col("value") <= 50)


@query("SELECT source, count(*) AS total, count(quality) AS found, (count(*) - count(quality)) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def source_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.counts_by(docs, "source", found=F.col("quality").isNotNull(), skipped=F.col("quality").isNull())


@query("""
    WITH paths AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'run/checkpoint-x' || o_orderkey WHEN 'P' THEN 'run/checkpoint-1-' || o_orderkey ELSE 'run/checkpoint-' || o_orderkey END AS path FROM orders),
    steps AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '(?:^|/)checkpoint-([0-9]{1,18})$', 1), '') AS BIGINT) AS step FROM paths)
    SELECT o_orderpriority, arg_max(path, step) AS path, max(step) AS step FROM steps WHERE step IS NOT NULL GROUP BY o_orderpriority""")
def latest_checkpoint(spark, d):
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), key)).when(F.col("o_orderstatus") == "P", F.concat(F.lit("1-"), key)).otherwise(key)
    return metrics.latest_checkpoint(table(spark, d, "orders").select("o_orderpriority", F.concat(F.lit("run/checkpoint-"), name).alias("path")), ["o_orderpriority"])


@query("""
    SELECT o_orderpriority, 'run/global_step_' || max(o_orderkey) AS path, max(o_orderkey) AS step FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority""")
def latest_actor(spark, d):
    part = F.when(F.col("o_orderstatus") == "F", "critic").otherwise("actor")
    folders = table(spark, d, "orders").select("o_orderpriority", F.concat(F.lit("run/global_step_"), F.col("o_orderkey").cast("string"), F.lit("/"), part).alias("path"))
    return metrics.latest_actor(folders, ["o_orderpriority"])


@query("SELECT 'hub/snapshots/' || max(p_brand) AS folder FROM part WHERE p_size > 10")
def newest_snapshot(spark, d):
    name = F.when(F.col("p_size") > 10, "config.json").otherwise("other.json")
    return metrics.newest_snapshot(table(spark, d, "part").select(F.concat(F.lit("hub/snapshots/"), F.col("p_brand"), F.lit("/"), name).alias("path")))


_PARAMS_SQL = "params AS (SELECT p_type || '.' || p_name AS name, p_size AS numel, p_retailprice > 1000 AS requires_grad FROM part)"


def _params(spark, d):
    return table(spark, d, "part").select(F.concat_ws(".", "p_type", "p_name").alias("name"), F.col("p_size").alias("numel"), (F.col("p_retailprice") > 1000).alias("requires_grad"))


@query(f"""WITH {_PARAMS_SQL} SELECT CASE WHEN name[:6] = 'SMALL.' OR name[:6] = 'LARGE.' THEN 'vision' WHEN name[:6] = 'PROMO.' THEN 'language' ELSE 'other' END AS bucket,
    contains(lower(name), 'ring') OR contains(lower(name), 'bolt') AS no_decay, count(*) AS n_params, sum(numel)::BIGINT AS numel FROM params WHERE requires_grad GROUP BY 1, 2""")
def param_groups(spark, d):
    return metrics.parameter_groups(_params(spark, d), ["SMALL.", "LARGE."], ["PROMO."], ["ring", "bolt"])


@query(f"""WITH {_PARAMS_SQL} SELECT pattern, (SELECT count_if(contains(name, pattern))::BIGINT FROM params) AS hits FROM (VALUES ('ring'), ('STANDARD'), ('absent')) AS x(pattern)""")
def freeze_hits(spark, d):
    return metrics.pattern_hits(_params(spark, d), ["ring", "STANDARD", "absent"])


@query(f"""WITH {_PARAMS_SQL}, f AS (SELECT numel, requires_grad AND NOT (name[:6] = 'SMALL.' OR contains(name, 'ring')) AS g FROM params)
    SELECT sum(CASE WHEN g THEN numel ELSE 0 END)::BIGINT AS trainable, sum(numel)::BIGINT AS total, round(sum(CASE WHEN g THEN numel ELSE 0 END)::DOUBLE / sum(numel)::DOUBLE, 9) AS share FROM f""")
def trainable_ratio(spark, d):
    return metrics.trainable_share(metrics.frozen(_params(spark, d), ["SMALL."], ["ring"])).withColumn("share", F.round("share", 9))


@query("SELECT event_id, event_id > 0 AND event_id < 900 AND event_id % 50 = 0 AS evaluates FROM events")
def eval_cadence(spark, d):
    return table(spark, d, "events").select("event_id", metrics.evaluates_at(F.col("event_id"), 50, 900).alias("evaluates"))


@query("""
    WITH names AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'eval_loss' WHEN 'view' THEN 'eval_runtime' WHEN 'error' THEN 'train_runtime' ELSE 'eval_' || event_type || '_steps_per_second' END AS name FROM events)
    SELECT event_id, name FROM names WHERE NOT (starts_with(name, 'eval_') AND (suffix(name, '_runtime') OR suffix(name, '_steps_per_second')))""")
def drop_timing_metrics(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "click", "eval_loss").when(kind == "view", "eval_runtime").when(kind == "error", "train_runtime").otherwise(F.concat(F.lit("eval_"), kind, F.lit("_steps_per_second")))
    return table(spark, d, "events").select("event_id", name.alias("name")).filter(~metrics.is_timing(F.col("name")))


@query("""
    WITH i AS (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped_exists' WHEN n_chars > 500 THEN 'ok' ELSE 'failed' END AS status FROM documents)
    SELECT 'documents.csv' AS csv_path, 'documents_plain' AS output_dir, count(*) AS total_rows, count_if(status <> 'failed')::BIGINT AS saved_images, count_if(status = 'failed')::BIGINT AS failed_images FROM i""")
def image_index_report(spark, d):
    tasks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_path"), "n_chars")
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return writers.export_report(writers.rendered(tasks, done, lambda batch: batch["n_chars"] > 500), "documents.csv", "documents_plain")


# --- records and tokens ------------------------------------------------------------


@query("""
    WITH u AS (SELECT conv_id, arg_min(text, turn) AS p FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, arg_min(text, turn) AS r FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id, '<|User|>;<|Assistant|>' AS roles, '<image>' || chr(10) || p AS prompt, r AS answer, conv_id || '.png' AS image FROM u JOIN a USING (conv_id)""")
def messages_build(spark, d):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(first("user").alias("p"), first("assistant").alias("r")).filter("p is not null and r is not null")
    built = turns.withColumn("m", arrays.messages(F.concat(F.lit("<image>\n"), "p"), F.concat(F.col("conv_id").cast("string"), F.lit(".png")), F.col("r")))
    return built.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ";").alias("roles"), F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("answer"), F.col("m")[0]["images"][0].alias("image"))


@query("""
    WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM benchmark)
    SELECT item_id, array_to_string(ids[:16], ',') AS kept_left, array_to_string(CASE WHEN len(ids) > 16 THEN ids[-16:] ELSE ids END, ',') AS kept_right,
        array_to_string(CASE WHEN len(ids) > 16 THEN list_concat(ids[:8], ids[-8:]) ELSE ids END, ',') AS kept_ends FROM t""")
def token_truncate(spark, d):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    return table(spark, d, "benchmark").select("item_id", *[F.array_join(arrays.truncated(ids, 16, how), ",").alias(name) for how, name in (("right", "kept_left"), ("left", "kept_right"), ("middle", "kept_ends"))])


@query("""
    WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM benchmark)
    SELECT item_id, array_to_string(list_transform(range(0, len(ids)), lambda i: CASE WHEN ids[i + 1] = 2 OR i % 7 = 3 OR i < 4 THEN -100 ELSE ids[i + 1] END), ',') AS labels,
        array_to_string(list_transform(ids, lambda x: CASE WHEN x = 2 THEN 0 ELSE 1 END), ',') AS attention FROM t""")
def label_mask(spark, d):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    return table(spark, d, "benchmark").select("item_id", F.array_join(arrays.labels(ids, F.transform(ids, lambda _, i: i % 7 == 3), F.lit(4), 2), ",").alias("labels"), F.array_join(arrays.attention(ids, 2), ",").alias("attention"))


@query("""
    WITH t AS (SELECT item_id, item_id // 8 AS batch, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM benchmark), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM t)
    SELECT item_id, width::INTEGER AS width, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: 0)), ',') AS padded FROM w""")
def pad_batch(spark, d):
    df = table(spark, d, "benchmark").withColumn("ids", F.transform(F.split("text", " "), lambda x: F.length(x))).withColumn("width", F.max(F.size("ids")).over(Window.partitionBy(F.floor(F.col("item_id") / 8))))
    return df.select("item_id", "width", F.array_join(arrays.padded(F.col("ids"), F.col("width"), 0), ",").alias("padded"))


@query("""
    WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids, 2 + item_id % 3 AS k FROM benchmark)
    SELECT item_id, array_to_string(list_concat([0], list_transform(range(0, k), lambda i: -1), ids, ids, [1]), ',') AS ids, k + 1 + len(ids) AS prompt_count,
        array_to_string(list_concat(['false'], list_transform(range(0, k), lambda i: 'true'), list_transform(range(0, 2 * len(ids) + 1), lambda i: 'false')), ',') AS image_mask FROM t""")
def sequence_assembly(spark, d):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    turns = F.array(F.struct(F.lit(arrays.USER).alias("role"), F.array(F.slice(ids, 1, 0), ids).alias("segments")), F.struct(F.lit(arrays.ASSISTANT).alias("role"), F.array(F.concat(ids, F.array(F.lit(1)))).alias("segments")))
    df = table(spark, d, "benchmark").withColumn("s", arrays.sequence(turns, 0, -1, 2 + F.col("item_id") % 3))
    return df.select("item_id", F.array_join("s.ids", ",").alias("ids"), F.col("s.prompt_count").cast("bigint").alias("prompt_count"), F.array_join(F.transform("s.image_mask", lambda x: x.cast("string")), ",").alias("image_mask"))


@query("""
    SELECT p_partkey, 257 + CASE WHEN p_size % 4 + 1 > 1 OR p_size % 3 + 1 > 1 THEN 144 * (p_size % 4 + 1) * (p_size % 3 + 1) ELSE 0 END AS n_tokens, 257 AS n_whole FROM part""")
def image_token_count(spark, d):
    w, h = F.col("p_size") % 4 + 1, F.col("p_size") % 3 + 1
    return table(spark, d, "part").select("p_partkey", scoring.image_tokens(w, h).alias("n_tokens"), scoring.image_tokens(w, h, crop=False).alias("n_whole"))


@query("SELECT doc_id, text AS content, lang AS data_source, doc_id || '.png' AS image_path, source AS truth FROM documents")
def rl_records(spark, d):
    df = table(spark, d, "documents").withColumn("image", F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    rows = df.select("doc_id", *[F.col(c) for c in ("text", "image", "lang", "source")])
    made = writers.rl_rows(rows, "text", "image", "lang", "source")
    prompt = F.from_json("prompt", "array<struct<role string, content string>>")
    return made.select(F.substring_index("image_path", ".", 1).cast("bigint").alias("doc_id"), prompt[0]["content"].alias("content"), "data_source", "image_path", text.ground_truth(F.col("reward_model")).alias("truth"))


@query(f"""
    WITH p AS (SELECT item_id, trim('<image>' || chr(10) || text, {_WS}) AS raw_prompt FROM benchmark),
    t AS (SELECT item_id, raw_prompt, list_transform(string_split(raw_prompt, ' '), lambda x: length(x)) AS every FROM p),
    i AS (SELECT *, every[-16:] AS ids, greatest(0, 16 - len(every)) AS gap FROM t)
    SELECT item_id, raw_prompt, array_to_string(list_concat(list_transform(range(0, gap), lambda x: 0), ids), ',') AS input_ids,
        array_to_string(list_transform(range(0, 16), lambda x: (x >= gap)::INTEGER), ',') AS attention_mask, array_to_string(list_transform(range(0, 16), lambda x: greatest(x - gap, 0)), ',') AS position_ids,
        CASE WHEN item_id % 2 = 0 THEN 'benchmark' ELSE 'other' END AS data_source, text AS ground_truth,
        CASE WHEN item_id % 3 = 0 THEN '{hashlib.md5(readers.blank_image()).hexdigest()}' ELSE md5(text) END AS image FROM i JOIN benchmark USING (item_id)""")
def rl_dataset(spark, d):
    bench = table(spark, d, "benchmark").withColumn("path", F.concat(F.col("item_id").cast("string"), F.lit(".png")))
    asked = bench.select("item_id", "path", F.concat(F.lit("<image>\n"), "text").alias("p"), F.when(F.col("item_id") % 2 == 0, "benchmark").alias("s"), F.col("text").alias("t"))
    rows = asked.select("item_id", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("p").alias("content")))).alias("prompt"), F.col("path").alias("image_path"), F.col("s").alias("data_source"), F.to_json(F.struct(F.col("t").alias("ground_truth"))).alias("reward_model"))
    files = bench.filter("item_id % 3 <> 0").select("path", F.encode("text", "utf-8").alias("content"))
    made = records.rl_dataset(rows, files, lambda c: F.transform(F.split(c, " "), lambda x: F.length(x)), 16, "left", at="item_id", source="other")
    shown = [F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "position_ids")]
    return made.select("item_id", "raw_prompt", *shown, "data_source", "ground_truth", F.md5("content").alias("image"))


# --- streaming ---------------------------------------------------------------------


@query("SELECT event_id AS step, value AS reward, NULL::BIGINT AS done, NULL::BIGINT AS total FROM events WHERE event_type <> 'error' UNION ALL SELECT NULL, NULL, event_id, user_id FROM events WHERE event_type = 'error'")
def reward_log_stream(spark, d):
    """The events as a trainer's log, read as a stream into a table."""
    path = _scratch(spark)
    step = F.concat(F.lit("(worker) step:"), F.col("event_id").cast("string"), F.lit(" - critic/rewards/mean:"), F.col("value").cast("string"), F.lit(" - time:1.0"))
    bar = F.concat(F.lit("Training Progress: 10%|# | "), F.col("event_id").cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    table(spark, d, "events").select(F.when(F.col("event_type") == "error", bar).otherwise(step).alias("value")).write.text(f"{path}/log")
    logs.tail(spark, f"{path}/log").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("step bigint, reward double, done bigint, total bigint").parquet(f"{path}/out")


@query("""
    SELECT event_id, user_id, greatest(k - coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS advance
    FROM (SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def running_step(spark, d):
    return logs.advances(_steps(spark, d), "user_id", "event_id", "k").select("event_id", "user_id", "advance")


@query(ORACLE_SQL["running_step"])
def running_step_stream(spark, d):
    """The same from a stream that is stopped and started again twice; each start goes on from the state kept."""
    path, lines = _scratch(spark), _steps(spark, d)
    edges = lines.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    width = (edges.b - edges.a) // 3 + 1 if edges.a is not None else 1
    for k in range(3):
        lines.filter(F.floor((F.col("event_id") - (edges.a or 0)) / width) == k).write.mode("append").parquet(f"{path}/in")
        stream = logs.advancing(spark.readStream.schema(lines.schema).parquet(f"{path}/in"), "user_id", "event_id", "k")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", "advance")


def _steps(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
