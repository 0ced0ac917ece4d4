import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from catalog.manifests import folder
from seqatlas.operators.features import STAGE_FEATURES
from seqatlas.sources import keypoints as KP, layout as L, tables as T


@query("src_csv_fallback", """
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS video, 'é' || n_name AS label, 'utf-8' AS _encoding FROM nation
UNION ALL SELECT 'ID', 'VIDEO', 'LABEL', 'utf-8'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'ok ' || c_mktsegment, 'utf-8' FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'đ' || s_suppkey, 'cp1258' FROM supplier
UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, NULL, 'latin1' FROM region
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'first,' || chr(10) || 'second "' || p_name || '"' || chr(10) || chr(10) || 'é', 'utf-8' FROM part
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL, 'đ' || chr(10) || n_name, 'cp1258' FROM nation""")
def src_csv_fallback(t):
    """Tables written as CSV and read back: upper-case headers, column orders that differ, a missing column, three
    encodings, a byte-order mark, a row that repeats the header, and quoted fields over several lines."""
    path = folder(t, "csv")

    def write(header, rows, charset="UTF-8"):
        """Lines as they stand, in as many files as there are tasks, each with its header."""
        raw = {"encoding": charset, "quote": "\u0000", "sep": "\u0001", "escapeQuotes": "false", "header": "true"}
        rows.select(F.col("value").alias(header)).write.mode("append").options(**raw).csv(path)

    line = lambda df, *parts: df.select(F.concat_ws(",", *parts).alias("value"))
    write(f"{T.BOM}ID,VIDEO,LABEL", line(t("nation"), "n_nationkey", "n_name", F.concat(F.lit("é"), "n_name")))
    write("ID,VIDEO,LABEL", t.spark.createDataFrame([("ID,VIDEO,LABEL",)], "value string"))
    write("id,video,label", line(t("customer"), "c_custkey", "c_name", F.concat(F.lit("ok "), "c_mktsegment")))
    # The byte of this Latin-1 letter is another letter in code page 1258.
    write("Label,Id,Video", line(t("supplier"), F.concat(F.lit("ð"), "s_suppkey"), "s_suppkey", "s_name"), "ISO-8859-1")
    write("id,VIDEO,note", line(t("region"), "r_regionkey", "r_name", F.lit("é\u008a")), "ISO-8859-1")

    def broken(rows, charset="UTF-8"):
        """Rows with line breaks inside quotes."""
        rows.write.mode("append").options(encoding=charset, header="true", escape='"').csv(path)

    part = F.concat(F.lit("first,\nsecond \""), "p_name", F.lit('"\n\né'))
    broken(t("part").select(F.col("p_partkey").alias("ID"), part.alias("Label"), F.col("p_brand").alias("Video")))
    broken(t("nation").select(F.concat(F.lit("ð\n"), "n_name").alias("label"), F.col("n_nationkey").alias("id")), "ISO-8859-1")
    return T.read_csv_any_encoding(t.spark, path, columns=["id", "video", "label"])


@query("src_csv_discover", "SELECT DISTINCT o_orderstatus AS folder, true AS has_bytes FROM orders WHERE o_orderstatus <> 'F'")
def src_csv_discover(t):
    path = folder(t, "tree")
    t("orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").option("header", True).csv(path)
    found = T.discover_files(t.spark, [path, path], "*.csv", skip=f"{path}/o_orderstatus=F")
    return found.select(F.regexp_extract("path", r"o_orderstatus=([^/]*)", 1).alias("folder"), (F.col("length") > 0).alias("has_bytes")).groupBy("folder").agg(F.bool_and("has_bytes").alias("has_bytes"))


@query("src_labels_flat", """
SELECT page_id, trim(url) AS video, trim(CASE WHEN page_id % 5 = 0 THEN '  ' ELSE ' ' || regexp_extract(url, 'https?://([^./]+)', 1) || ' ' END) AS label FROM pages
WHERE page_id % 5 <> 0""")
def src_labels_flat(t):
    label = F.when(F.col("page_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.regexp_extract("url", "https?://([^./]+)", 1), F.lit(" ")))
    return T.labels_flat(t("pages").select("page_id", F.col("url").alias("Video"), label.alias("LABEL")))


@query("src_labels_nested", r"""
WITH i AS (SELECT lang || '-' || source AS gloss, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id || '_' || i AS video_id, gloss, CAST(i AS INTEGER) AS signer_id FROM i WHERE trim(line) <> ''""")
def src_labels_nested(t):
    lines = F.split("text", "\n")
    name = lambda l, i: F.when(F.trim(l) != "", F.concat(F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))
    instances = F.transform(lines, lambda l, i: F.struct(name(l, i).alias("video_id"), i.alias("signer_id")))
    return T.labels_nested(t("documents").select(F.concat_ws("-", "lang", "source").alias("gloss"), instances.alias("instances")))


@query("src_labels_exist", """
SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS "exists" FROM documents""")
def src_labels_exist(t):
    docs, files = t("documents").select("doc_id", "lang"), t("labels")
    have = T.existing_labels(docs, files, "doc_id").withColumn("exists", F.lit(True))
    return have.unionByName(T.missing_labels(docs, files, "doc_id").withColumn("exists", F.lit(False)))


PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"


@query("src_file_inventory", f"""
WITH p AS (SELECT {PATH} AS path FROM pages)
SELECT regexp_extract(path, '([^/]+)/[^/]*$', 1) AS folder, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS extension, count(*) AS files FROM p GROUP BY ALL""")
def src_file_inventory(t):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return T.file_inventory(t("pages").select(path.alias("path")), extensions=None)


def _archives(batches):
    for batch in batches:
        out = []
        for ident, values in zip(batch["vec_id"], batch["embedding"]):
            buffer = io.BytesIO()
            np.savez(buffer, keypoints=np.asarray(values, dtype=np.float32).reshape(32, 2), source_fps=np.float32(ident % 30))
            out.append((f"D{ident % 2}/label/{ident}.npz", b"broken" if ident % 50 == 0 else buffer.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def archives(t):
    """One keypoint archive per embedding row, every fiftieth of them broken."""
    from pyspark import cloudpickle
    import catalog

    cloudpickle.register_pickle_by_value(catalog)
    return t("embeddings").select("vec_id", "embedding").mapInPandas(_archives, "path string, content binary")


@query("src_keypoint_frames", """
SELECT 'D' || vec_id % 2 || '/label/' || vec_id || '.npz' AS path, CAST(k AS BIGINT) AS frame, CAST(embedding[2*k+1] AS DOUBLE) AS x, CAST(embedding[2*k+2] AS DOUBLE) AS y, CAST(vec_id % 30 AS DOUBLE) AS source_fps, false AS failed
FROM embeddings, range(32) t(k) WHERE vec_id % 50 <> 0
UNION ALL SELECT 'D' || vec_id % 2 || '/label/' || vec_id || '.npz', NULL, NULL, NULL, NULL, true FROM embeddings WHERE vec_id % 50 = 0""")
def src_keypoint_frames(t):
    f = KP.decode_frames(archives(t))
    value = lambda i: F.get("row", F.lit(i)).cast("double")
    return f.select("path", "frame", value(0).alias("x"), value(1).alias("y"), "source_fps", F.col("error").isNotNull().alias("failed"))


@query("src_layout_decode", """
WITH f AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_concat(embedding, embedding) ELSE list_concat(list_concat(embedding, embedding), list_concat(embedding, embedding)[1:58]) END AS r FROM embeddings),
o AS (SELECT vec_id, r, len(r) - 126 AS h FROM f)
SELECT vec_id, 'left' AS part, CAST(k AS INTEGER) AS landmark, CAST(r[h+3*k+1] AS DOUBLE) AS x, CAST(r[h+3*k+2] AS DOUBLE) AS y, CAST(r[h+3*k+3] AS DOUBLE) AS z FROM o, range(21) t(k)
UNION ALL SELECT vec_id, 'right', CAST(k AS INTEGER), CAST(r[h+63+3*k+1] AS DOUBLE), CAST(r[h+63+3*k+2] AS DOUBLE), CAST(r[h+63+3*k+3] AS DOUBLE) FROM o, range(21) t(k)
UNION ALL SELECT vec_id, 'pose', CAST(k AS INTEGER), CAST(r[4*k+1] AS DOUBLE), CAST(r[4*k+2] AS DOUBLE), CAST(r[4*k+3] AS DOUBLE) FROM o, range(15) t(k) WHERE h = 60""")
def src_layout_decode(t):
    twice = F.concat("embedding", "embedding")
    row = F.when(F.col("vec_id") % 2 == 0, twice).otherwise(F.concat(twice, F.slice(twice, 1, 58)))
    decoded = L.decode_flat(t("embeddings").select("vec_id", row.alias("r")), "r")
    return L.part_rows(decoded, ["vec_id"], ["left", "right", "face", "pose"])


K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


ARCHIVES = 500  # of a batch; each is much larger than the row it is made of


def _extracted(batches):
    for batch in batches:
        out = []
        for ident, values in zip(batch["vec_id"], batch["embedding"]):
            buffer, n = io.BytesIO(), 8 + ident % 3
            rows = np.tile(np.asarray(values, dtype=np.float32), (n, 1))
            mask = np.array([[values[4 * f + p] > 0 for p in range(4)] for f in range(n)])
            more = {"video_name": np.array(f"{ident}.mp4"), "source_fps": np.array(ident % 30 + 0.5), "source_total_frames": np.array(3 * ident)}
            if ident % 4:
                more["target_frames"] = np.array(n)
            if ident % 7:
                more["valid_mask"] = mask
            np.savez(buffer, pose=rows, hands=rows, **more)
            out.append((f"label/{ident}.npz", b"broken" if ident % 50 == 0 else buffer.getvalue()))
            if len(out) == ARCHIVES:
                yield pd.DataFrame(out, columns=["path", "content"])
                out = []
        yield pd.DataFrame(out, columns=["path", "content"])


MASK_SQL = ", ".join(f"{R(f'CASE WHEN vec_id % 7 > 0 THEN (SELECT avg(CAST(embedding[4 * f + {i + 1}] > 0 AS INT)) FROM range(8 + vec_id % 3) r(f)) END')} AS valid_{p}_ratio" for i, p in enumerate(L.MASK))


@query("src_npz_metadata", f"""
SELECT 'label/' || vec_id || '.npz' AS path, 8 + vec_id % 3 AS num_frames, vec_id || '.mp4' AS video_name, CAST(vec_id % 30 + 0.5 AS DOUBLE) AS source_fps, 3 * vec_id AS source_total_frames,
  CASE WHEN vec_id % 4 > 0 THEN 8 + vec_id % 3 END AS target_frames, {MASK_SQL}, false AS failed FROM embeddings WHERE vec_id % 50 > 0
UNION ALL SELECT 'label/' || vec_id || '.npz', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM embeddings WHERE vec_id % 50 = 0""")
def src_npz_metadata(t):
    """Scalars and mask shares of extraction archives, one in four without the frame target, one in seven without mask."""
    from pyspark import cloudpickle
    import catalog

    cloudpickle.register_pickle_by_value(catalog)
    files = t("embeddings").select("vec_id", "embedding").mapInPandas(_extracted, "path string, content binary")
    meta = KP.archive_metadata(KP.decode_frames(files))
    return rounded(meta.withColumn("failed", F.col("error").isNotNull()).drop("error"), *[f"valid_{p}_ratio" for p in L.MASK])


@query("src_mask_ratios", f"""
SELECT user_id, count(*) AS num_frames, {R("avg(CAST(value > 40 AS INT))")} AS valid_pose_ratio, {R(f"avg(CAST({K} > 50 AS INT))")} AS valid_left_hand_ratio,
  {R("avg(CAST(event_type = 'click' AS INT))")} AS valid_right_hand_ratio, {R("avg(CAST(event_id % 3 = 0 AS INT))")} AS valid_face_ratio FROM events GROUP BY user_id""")
def src_mask_ratios(t):
    k = F.get_json_object("props", "$.k").cast("double")
    flags = {"pose": F.col("value") > 40, "left_hand": k > 50, "right_hand": F.col("event_type") == "click", "face": F.col("event_id") % 3 == 0}
    rows = t("events").withColumns({f"v_{p}": c for p, c in flags.items()})
    return rounded(L.mask_ratios(rows, ["user_id"], {f"valid_{p}_ratio": f"v_{p}" for p in L.MASK}))


LABEL_MAP = "m AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS label FROM nation UNION ALL SELECT 'class_' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), n_name FROM nation)"


@query("src_label_map", f"WITH {LABEL_MAP} SELECT key, label FROM m")
def src_label_map(t):
    return T.label_map(t("nation"), "n_nationkey", "n_name")


@query("src_label_resolve", f"""
WITH {LABEL_MAP}, p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 30 AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.0' ELSE '' END END AS raw,
   {PATH} || CASE WHEN page_id % 7 = 0 THEN '/class_00' || lpad(CAST(page_id % 40 AS VARCHAR), 2, '0') || '_x.npz' ELSE '' END AS path FROM pages),
k AS (SELECT *, regexp_replace(raw, '^([0-9]+)[.]0$', '\\1') AS k0, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS k1, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)[.][^.]*$', '\\1') AS k2, regexp_extract(path, '(class_[0-9]+)', 1) AS k3 FROM p)
SELECT page_id, CASE WHEN k0 IS NOT NULL THEN coalesce(m0.label, k0) ELSE coalesce(m1.label, m2.label, m3.label, nullif(k1, ''), k2) END AS label
FROM k LEFT JOIN m m0 ON m0.key = k0 LEFT JOIN m m1 ON m1.key = k1 LEFT JOIN m m2 ON m2.key = k2 LEFT JOIN m m3 ON m3.key = k3""")
def src_label_resolve(t):
    n = F.col("page_id")
    raw = F.when(n % 3 == 0, F.concat((n % 30).cast("string"), F.when(n % 2 == 0, F.lit(".0")).otherwise(F.lit(""))))
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    file = F.when(n % 7 == 0, F.concat(F.lit("/class_00"), F.lpad((n % 40).cast("string"), 2, "0"), F.lit("_x.npz"))).otherwise(F.lit(""))
    rows = t("pages").select("page_id", raw.alias("raw"), F.concat(path, file).alias("path"))
    return T.resolve_labels(rows, T.label_map(t("nation"), "n_nationkey", "n_name"), raw="raw", path="path").select("page_id", "label")


@query("src_path_metadata", f"WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS gloss, regexp_extract(path, '([^/]*)$', 1) AS video FROM p")
def src_path_metadata(t):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    gloss, video = T.path_metadata(F.translate(path, "/", "\\"))
    return t("pages").select("page_id", gloss.alias("gloss"), video.alias("video"))


@query("src_probe_metadata", f"""
WITH e AS (SELECT event_id, event_id % 6 AS c, CAST({K} AS INTEGER) AS k, value FROM events),
r AS (SELECT event_id, c, k, CASE WHEN c = 0 THEN NULL WHEN c = 1 THEN NULL ELSE (30000 + k) / 1001.0 END AS fps, CASE WHEN c IN (0, 3) THEN NULL ELSE k + 1 END AS nb, CASE WHEN c IN (0, 2, 5) THEN NULL ELSE value END AS dur FROM e),
f AS (SELECT *, coalesce(nb, CAST(round_even(dur * fps, 0) AS BIGINT)) AS n FROM r), g AS (SELECT *, fps IS NOT NULL AND n IS NOT NULL AS ok FROM f)
SELECT event_id, CASE WHEN ok THEN {R('coalesce(dur, n / fps)')} END AS duration_seconds, CASE WHEN ok THEN CAST(n AS BIGINT) END AS frame_count, CASE WHEN ok THEN {R('fps')} END AS fps,
  CASE WHEN ok THEN CAST(k * 2 AS INTEGER) END AS width, CASE WHEN ok THEN CAST(k AS INTEGER) END AS height, CASE WHEN ok THEN 'h264' END AS codec, ok AS readable FROM g""")
def src_probe_metadata(t):
    k = F.get_json_object("props", "$.k").cast("int")
    c = F.col("event_id") % 6
    rate = F.when(c == 1, F.concat(k.cast("string"), F.lit("/0"))).otherwise(F.concat((30000 + k).cast("string"), F.lit("/1001")))
    stream = F.to_json(F.struct(
        F.lit("h264").alias("codec_name"), (k * 2).alias("width"), k.alias("height"), rate.alias("r_frame_rate"),
        F.when(c != 3, (k + 1).cast("string")).alias("nb_frames"), F.when(~c.isin(2, 5), F.col("value").cast("string")).alias("duration"),
    ))
    payload = F.when(c == 0, F.lit('{"streams":[]}')).otherwise(F.concat(F.lit('{"streams":['), stream, F.lit("]}")))
    out = T.probe_metadata(t("events").select("event_id", payload.alias("payload"))).drop("payload")
    return rounded(out)


@query("src_fourcc", """
WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE 97 + l_orderkey % 26 + (98 + l_partkey % 20) * 256 + (48 + l_linenumber) * 65536 + CASE WHEN l_orderkey % 4 = 0 THEN 32 ELSE 49 END * 16777216 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN c > 0 THEN trim(chr(CAST(c % 256 AS INTEGER)) || chr(CAST((c // 256) % 256 AS INTEGER)) || chr(CAST((c // 65536) % 256 AS INTEGER)) || chr(CAST((c // 16777216) % 256 AS INTEGER))) END AS codec FROM c""")
def src_fourcc(t):
    from seqatlas.functions.text import fourcc

    code = 97 + F.col("l_orderkey") % 26 + (98 + F.col("l_partkey") % 20) * 256 + (48 + F.col("l_linenumber")) * 65536
    code = code + F.when(F.col("l_orderkey") % 4 == 0, 32).otherwise(49) * 16777216
    return t("lineitem").select("l_orderkey", "l_linenumber", fourcc(F.when(F.col("l_linenumber") == 1, 0).otherwise(code)).alias("codec"))


@query("src_whitelist", r"""
WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
n AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') AS s, nullif(regexp_extract(line, ' ([a-z]+)[.]$', 1), '') AS c FROM l),
f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, section, c AS "column" FROM f WHERE s IS NULL AND c IS NOT NULL AND section IS NOT NULL""")
def src_whitelist(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    out = T.schema_listing(lines, "line_no", "line", section=r"^([A-Z][a-z]+) ", column=r" ([a-z]+)[.]$", group=["doc_id"])
    return out.select("doc_id", "line_no", "section", "column")
