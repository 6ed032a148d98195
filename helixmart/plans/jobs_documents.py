"""Jobs for papers, chunks, ledgers, vectors, routing, evaluation and chat notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import documents as D, evaluation as E, quality, retrieval as R, similarity as S
from helixmart.plans.check_views import pick, rnd
from helixmart.plans.jobs_features import rounded
from helixmart.plans.jobs_similarity import clinical, scored
from helixmart.plans.registry import CHECK_VIEWS, job

V = CHECK_VIEWS

V["paper_texts"] = """
SELECT 'PMC' || doc_id AS paper_id, array_to_string(list_transform(range(0, greatest(length(text), 1), 3000),
 lambda s : substring(text, s + 1, 3000)), chr(10)) || chr(10) AS full_text FROM documents"""
V["chunks"] = """
SELECT paper_id, CAST(s // 800 AS INT) AS chunk_index, substring(full_text, s + 1, 1000) AS chunk_text, CAST(s AS INT) AS start_char,
 CAST(least(s + 1000, length(full_text)) AS INT) AS end_char, CAST(s // 3001 + 1 AS INT) AS start_page,
 CAST((least(s + 1000, length(full_text)) - 1) // 3001 + 1 AS INT) AS end_page, sha256(full_text) AS content_hash
FROM (SELECT *, unnest(range(0, length(full_text), 800)) AS s FROM paper_texts)"""
V["evidence_terms"] = """
SELECT paper_id, min_by(chunk_text, chunk_index) AS chunk_text FROM chunks
WHERE length(chunk_text) > 200 AND regexp_matches(lower(chunk_text), 'tmb|survival|prognosis|treatment|outcomes|the') GROUP BY paper_id"""
V["evidence"] = """
SELECT CAST(row_number() OVER (ORDER BY md5(paper_id || 'evidence'), paper_id) AS INT) AS place, paper_id, chunk_text
FROM evidence_terms QUALIFY place <= 5"""

_TERMS = [*C.EVIDENCE_TERMS, "the"]


def papers(w):
    return D.split_pages(w["documents"], F.concat(F.lit("PMC"), F.col("doc_id").cast("string")))


def chunks(w):
    return D.chunk(papers(w))


job("i1_chunks", "SELECT paper_id, chunk_index, chunk_text, start_char, end_char FROM chunks")(
    lambda w: chunks(w).select("paper_id", "chunk_index", "chunk_text", "start_char", "end_char"))
job("i1_chunks_from_page_rows", """
SELECT paper_id, chunk_index, chunk_text, start_char, end_char, start_page, end_page FROM chunks""")(
    lambda w: D.chunk_page_rows(D.page_rows(papers(w))).select(
        "paper_id", "chunk_index", "chunk_text", "start_char", "end_char", "start_page", "end_page"))
job("i2_page_spans", """
SELECT paper_id, chunk_index, start_page, end_page, array_to_string(range(start_page, end_page + 1), ',') AS pages_spanned FROM chunks""")(
    lambda w: chunks(w).select("paper_id", "chunk_index", "start_page", "end_page", F.array_join(
        F.col("pages_spanned").cast("array<string>"), ",").alias("pages_spanned")))
job("i3_hashes", "SELECT paper_id, chunk_index, content_hash, sha256(chunk_text) AS chunk_hash FROM chunks")(
    lambda w: chunks(w).select("paper_id", "chunk_index", "content_hash", "chunk_hash"))
job("i3_hashes_from_page_rows", "SELECT paper_id, chunk_index, content_hash, sha256(chunk_text) AS chunk_hash FROM chunks")(
    lambda w: D.chunk_page_rows(D.page_rows(papers(w)), hashed=True).select("paper_id", "chunk_index", "content_hash", "chunk_hash"))
job("a6_page_rows", """
SELECT 'PMC' || doc_id AS paper_id, CAST(s // 3000 + 1 AS INT) AS page_number, substring(text, s + 1, 3000) AS text,
 CAST(length(substring(text, s + 1, 3000)) AS INT) AS char_count
FROM (SELECT *, unnest(range(0, greatest(length(text), 1), 3000)) AS s FROM documents)""")(
    lambda w: D.page_rows(papers(w)))
job("a6_gathered_pages", "SELECT paper_id, sha256(full_text) AS content_hash FROM paper_texts")(
    lambda w: D.gather_pages(D.page_rows(papers(w))).select(
        "paper_id", F.sha2(D.full_text(F.col("pages")), 256).alias("content_hash")))
job("i4_text_ledger_rows", """
SELECT paper_id, count(*) AS text_chunks_count FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM text_processed) GROUP BY paper_id""")(
    lambda w: D.text_ledger_rows(chunks(w), w["text_processed"]))
job("i5_image_ledger_rows", """
SELECT pmc_id AS paper_id, coalesce(n, 0) AS images_count FROM papers LEFT JOIN
 (SELECT paper_id, count(*) AS n FROM image_vectors GROUP BY paper_id) i ON pmc_id = i.paper_id
WHERE pmc_id NOT IN (SELECT paper_id FROM images_processed)""")(
    lambda w: D.image_ledger_rows(w["papers"], w["image_vectors"], w["images_processed"]))
_IMAGE_URL = "'s3://images/papers/' || paper_id || '/page_' || page_number || '_img_' || image_index || '.' || format"
job("i6_unique_images", f"""
SELECT image_hash, paper_id, page_number, image_index, {_IMAGE_URL} AS s3_url, width, height, format FROM image_vectors
QUALIFY row_number() OVER (PARTITION BY image_hash ORDER BY paper_id, page_number, image_index) = 1""")(
    lambda w: D.unique_images(D.image_rows(w["image_vectors"])))
job("a7_image_keys", f"SELECT id, {_IMAGE_URL} AS s3_url FROM image_vectors")(
    lambda w: D.image_rows(w["image_vectors"]).select("id", "s3_url"))
job("i7_remaining_work", """
SELECT n AS remaining, CAST(ceil(n / 25) AS BIGINT) AS rounds, ceil(n / 25) > 200 AS over_ceiling,
 CASE WHEN n > 0 THEN 'trigger_next_run' ELSE 'end_processing' END AS next_step
FROM (SELECT count(*) AS n FROM papers WHERE pmc_id NOT IN (SELECT paper_id FROM text_processed))""")(
    lambda w: D.remaining_work(w["papers"], w["text_processed"]))
job("c7_unprocessed_text", "SELECT pmc_id, s3_url, doi, title FROM papers WHERE pmc_id NOT IN (SELECT paper_id FROM text_processed)")(
    lambda w: D.unprocessed(w["papers"], w["text_processed"]).select("pmc_id", "s3_url", "doi", "title"))
job("c7_unprocessed_images", "SELECT pmc_id, s3_url, doi, title FROM papers WHERE pmc_id NOT IN (SELECT paper_id FROM images_processed)")(
    lambda w: D.unprocessed(w["papers"], w["images_processed"]).select("pmc_id", "s3_url", "doi", "title"))
job("f9_next_batch", "SELECT pmc_id FROM papers WHERE pmc_id NOT IN (SELECT paper_id FROM text_processed) ORDER BY pmc_id LIMIT 25")(
    lambda w: D.next_batch(w["papers"], w["text_processed"]).select("pmc_id"))
job("d27_chunks_per_paper", "SELECT paper_id, count(*) AS n_chunks FROM chunks GROUP BY paper_id")(
    lambda w: D.per_paper(chunks(w), "n_chunks"))
job("d27_images_per_paper", "SELECT paper_id, count(*) AS n_images FROM image_vectors GROUP BY paper_id")(
    lambda w: D.per_paper(w["image_vectors"], "n_images"))
job("c9_existing_ids", "SELECT DISTINCT pmc_id FROM papers WHERE pmc_id IN (SELECT paper_id FROM text_processed)")(
    lambda w: D.existing_ids(w["papers"], w["text_processed"].withColumnRenamed("paper_id", "pmc_id")))
job("c10_new_ids", "SELECT pmc_id FROM papers WHERE pmc_id NOT IN (SELECT paper_id FROM images_processed)")(
    lambda w: D.new_ids(w["papers"].select("pmc_id"), w["images_processed"].withColumnRenamed("paper_id", "pmc_id")))
job("c17_id_conversion", """
SELECT m.pmid, m.pmc_id FROM id_map m JOIN documents d ON m.pmid = CAST(d.doc_id AS VARCHAR) WHERE m.pmc_id IS NOT NULL""")(
    lambda w: w["documents"].select(F.col("doc_id").cast("string").alias("pmid")).join(
        w["id_map"].where(F.col("pmc_id").isNotNull()), "pmid"))
job("e4_unique_in_order", """
SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id""")(
    lambda w: D.unique_in_order(w["events"], "user_id", "event_id"))
job("g3_stored_not_catalogued", """
SELECT pmc_id FROM id_map WHERE pmc_id IS NOT NULL EXCEPT SELECT paper_id FROM text_processed""")(
    lambda w: w["id_map"].where(F.col("pmc_id").isNotNull()).select("pmc_id").subtract(
        w["text_processed"].select(F.col("paper_id").alias("pmc_id"))))
job("g4_repaired_catalogue", """
SELECT p.pmc_id, title, abstract, authors, doi, s3_url FROM papers p WHERE p.pmc_id IN (SELECT paper_id FROM text_processed)
UNION ALL SELECT pmc_id, 'Paper ' || pmc_id, 'Metadata not available', 'Unknown', 'Not available', 's3://papers/' || pmc_id || '.pdf'
FROM (SELECT pmc_id FROM id_map WHERE pmc_id IS NOT NULL EXCEPT SELECT paper_id FROM text_processed)""")(
    lambda w: D.with_repaired(
        w["papers"].join(w["text_processed"].select(F.col("paper_id").alias("pmc_id")), "pmc_id", "left_semi"),
        w["id_map"].where(F.col("pmc_id").isNotNull())))
_PAPER_HOST = "'https://ftp.ncbi.nlm.nih.gov/pub/pmc/oa_pdf/' || left(n, 2) || '/' || n"
job("a21_fetch_locations", f"""
SELECT pmc_id, concat_ws(' ', {_PAPER_HOST} || '/' || pmc_id || '.PMC' || n || '.pdf', {_PAPER_HOST} || '/PMC' || n || '.pdf',
 {_PAPER_HOST} || '/' || pmc_id || '.pdf', 'https://europepmc.org/backend/ptpmcrender.fcgi?accid=PMC' || n || '&blobtype=pdf') AS locations,
 's3://papers/pdf/' || pmc_id || '.pdf' AS stored_path FROM (SELECT pmc_id, substring(pmc_id, 4) AS n FROM papers)""")(
    lambda w: D.fetch_locations(w["papers"]).withColumn("locations", F.array_join("locations", " ")))
job("a9_pdf_links", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://host.example/p' || page_id || '.pdf'
 WHEN 1 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/v' || page_id || '.pdf'
 WHEN 2 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/pdf/a' || page_id || '.pdf' WHEN 3 THEN 'https://mirror.example/pdf/b.pdf'
 ELSE 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || page_id || '/pdf/' END AS pdf_url FROM landed_pages""")(
    lambda w: D.extract_pdf_link(w["landed_pages"]))
job("a13_typed_vectors", """
SELECT id, v IS NOT NULL AND len(v) = 3 AS is_valid, list_sum(v) AS total
FROM (SELECT id, TRY_CAST(embedding_json AS DOUBLE[]) AS v FROM staged_vectors)""")(
    lambda w: R.parsed_vectors(w["staged_vectors"], "embedding_json", 3).select(
        "id", "is_valid", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")))
job("e2_first_chunk_per_paper", "SELECT paper_id, chunk_text FROM evidence_terms")(
    lambda w: D.first_matching_chunk(chunks(w), _TERMS))
job("f8_sampled_chunks", "SELECT paper_id, chunk_text FROM evidence")(
    lambda w: D.sampled(D.first_matching_chunk(chunks(w), _TERMS), "paper_id", "evidence"))
job("i11_evidence", f"""
SELECT place, paper_id, substring(chunk_text, 1, 500) AS chunk_text, {rnd("0.9 - place * 0.05", 2)} AS similarity_score,
 place || '. [' || paper_id || ']: ' || substring(chunk_text, 1, 150) || '...' AS line FROM evidence""")(
    lambda w: D.evidence(chunks(w), terms=_TERMS))
V["evidence_text"] = """
SELECT count(*) AS n_papers, 'Key findings from ' || count(*) || ' papers:' || chr(10) || string_agg(place || '. [' || paper_id || ']: '
 || substring(chunk_text, 1, 150) || '...', chr(10) ORDER BY place) || chr(10) AS summary FROM evidence"""
job("i11_evidence_summary", "SELECT * FROM evidence_text")(
    lambda w: D.evidence_summary(D.evidence(chunks(w), terms=_TERMS)))
_SCORE = "CAST(mutation_count AS DOUBLE) / 6"


def _phrases() -> str:
    (_, high, a), (_, mid, b) = C.SEARCH_PHRASES
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return f"CASE WHEN {_SCORE} >= {high} THEN {quote(a)} WHEN {_SCORE} >= {mid} THEN {quote(b)} ELSE {quote(C.SEARCH_PHRASE_REST)} END"


job("i15_search_phrase", f"SELECT sample_id, {_phrases()} AS search_terms FROM stg_clinical")(
    lambda w: w["stg_clinical"].select("sample_id", D.search_phrase(F.col("mutation_count") / 6.0).alias("search_terms")))
def risk_with_evidence(w):
    """Score, five nearest patients and the literature text in one row per patient."""
    near = F.sort_array(F.collect_list(F.struct("place", "neighbour_id")))
    neighbours = S.nearest_by_burden(clinical(w), clinical(w)).groupBy("sample_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(near, lambda x: x["neighbour_id"]), ",").alias("closest"))
    found = D.evidence_summary(D.evidence(chunks(w), terms=_TERMS)).select(F.struct("n_papers", "summary").alias("e"))
    return (
        scored(w).join(neighbours, "sample_id", "left")
        .withColumn("e", found.scalar())
        .select("sample_id", S.lookups.risk_level(F.col("risk_score")).alias("risk_level"),
                F.coalesce("n", F.lit(0)).cast("bigint").alias("similar_patients_found"), "closest",
                "e.n_papers", "e.summary"))


job("m5_risk_analysis_with_evidence", f"""
SELECT sample_id, {pick(f"{_SCORE} >= 80 : 'VERY_HIGH_RISK'", f"{_SCORE} >= 60 : 'HIGH_RISK'", f"{_SCORE} >= 40 : 'MODERATE_RISK'", rest="'LOW_RISK'")} AS risk_level,
 coalesce(n, 0) AS similar_patients_found, closest, e.n_papers, e.summary
FROM mart_risk_features_clinical LEFT JOIN (SELECT sample_id, count(*) AS n, string_agg(neighbour_id, ',' ORDER BY place) AS closest
 FROM near_burden GROUP BY sample_id) USING (sample_id), evidence_text e""")(
    risk_with_evidence)


job("i13_numbered_names", """
SELECT answer_id, CAST(1 AS INT) AS entry, 'Center ' || c_name AS name, 'Street ' || c_nationkey || '<br>Type: NCI' AS body
FROM (SELECT c_custkey AS answer_id, * FROM customer)
UNION ALL SELECT c_custkey, 2, c_mktsegment || ' Clinic', 'Phone' FROM customer""")(
    lambda w: D.numbered_names(w["generated_texts"].select("answer_id", "centres"), "centres"))
job("i13_numbered_sections", """
SELECT c_custkey AS answer_id, CAST(1 AS INT) AS section_no, 'RISK INTERPRETATION' AS header, 'Risk of ' || c_name || ' in ' || c_mktsegment AS content
FROM customer UNION ALL SELECT c_custkey, 3, t, t FROM (SELECT c_custkey, 'PROGNOSIS for balance ' || c_nationkey || ' and more words' AS t FROM customer)""")(
    lambda w: D.numbered_sections(w["generated_texts"].select("answer_id", "answer"), "answer"))
job("i14_tidy_replies", "SELECT c_custkey AS answer_id, 'SELECT ' || c_custkey AS sql_text, 'Finding ' || c_name AS insight FROM customer")(
    lambda w: w["generated_texts"].select(
        "answer_id", D.tidy_sql(F.col("sql_reply")).alias("sql_text"), D.tidy_insight(F.col("insight_reply")).alias("insight")))

# -- retrieval -------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 9)"
for _name, _table, _cut in [("text_hits", "text_vectors", 0.3), ("image_hits", "image_vectors", 0.25)]:
    V[_name] = f"""
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place
FROM (SELECT q.query_id, t.id, {_COS.format("t.embedding", "q.embedding")} AS score FROM query_vectors q CROSS JOIN {_table} t)
WHERE score > {_cut} QUALIFY place <= 5"""
V["hits"] = "SELECT *, 'text' AS kind FROM text_hits UNION ALL SELECT *, 'image' AS kind FROM image_hits"
V["answer_confidence"] = """
SELECT q.query_id, coalesce(avg(score), 0) AS confidence, count(*) FILTER (kind = 'text') AS n_text,
 count(*) FILTER (kind = 'image') AS n_images, count(kind) > 0 AS has_sources FROM query_vectors q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id"""
_TEXT_TIER = pick("score > 0.7 : 'HIGH'", "score >= 0.5 : 'MEDIUM'", "score >= 0.3 : 'LOW'")
_IMAGE_TIER = pick("score > 0.6 : 'HIGH'", "score >= 0.4 : 'MEDIUM'", "score >= 0.25 : 'LOW'")


def text_hits(w):
    return R.search_text(w["text_vectors"], w["query_vectors"])


def image_hits(w):
    return R.search_images(w["image_vectors"], w["query_vectors"])


def hits(w):
    return R.all_hits(text_hits(w), image_hits(w))


job("j1_text_search", f"SELECT query_id, id, place, {rnd('score', 6)} AS score FROM text_hits")(
    lambda w: rounded(text_hits(w).drop("tier"), {"score": 6}))
job("j2_image_search", f"SELECT query_id, id, place, {rnd('score', 6)} AS score FROM image_hits")(
    lambda w: rounded(image_hits(w).drop("tier"), {"score": 6}))
job("c11_query_similarity", f"SELECT query_id, id, {rnd('score', 6)} AS score FROM text_hits WHERE place = 1")(
    lambda w: rounded(text_hits(w).where("place = 1").select("query_id", "id", "score"), {"score": 6}))
job("f5_top_k_per_query", "SELECT query_id, id, place FROM text_hits WHERE place <= 3")(
    lambda w: R.search_text(w["text_vectors"], w["query_vectors"], k=3).select("query_id", "id", "place"))
job("j3_tiers", f"""
SELECT query_id, id, kind, CASE kind WHEN 'text' THEN {_TEXT_TIER} ELSE {_IMAGE_TIER} END AS tier FROM hits""")(
    lambda w: hits(w).select("query_id", "id", "kind", "tier"))
job("j4_confidence", f"SELECT query_id, {rnd('confidence', 6)} AS confidence, n_text, n_images, has_sources FROM answer_confidence")(
    lambda w: rounded(R.confidence(w["query_vectors"], hits(w)), {"confidence": 6}))
_ROUTE = """CASE WHEN c > 0.6 THEN 'RAG' WHEN c < 0.5 THEN 'Arxiv + Web' WHEN c + b > 0.6 THEN 'RAG + Arxiv' ELSE 'RAG + Arxiv + Web' END AS agent_used,
 {} AS combined_confidence"""
_COMBINED = rnd("CASE WHEN c > 0.6 THEN c WHEN c < 0.5 THEN least(c + o, 0.95) ELSE c + b END", 6)
_BOOSTS = """CAST(CASE WHEN papers >= 2 THEN 0.1 ELSE 0.05 END AS DOUBLE) AS b,
 CAST(CASE WHEN papers >= 2 THEN 0.15 ELSE 0.1 END AS DOUBLE) + CAST(CASE WHEN web >= 3 THEN 0.15 ELSE 0.1 END AS DOUBLE) AS o"""
job("j5_routes", f"""
SELECT query_id, {_ROUTE.format(_COMBINED)} FROM (SELECT *, {_BOOSTS} FROM (SELECT query_id, round(confidence, 6) AS c,
 query_id % 4 AS papers, query_id % 5 AS web FROM answer_confidence))""")(
    lambda w: rounded(R.confidence(w["query_vectors"], hits(w)).withColumn("confidence", F.round("confidence", 6)).select(
        "query_id", *R.route(F.col("confidence"), F.col("query_id") % 4, F.col("query_id") % 5)), {"combined_confidence": 6}))
job("j5_route_table", f"""
SELECT event_id, {_ROUTE.format(_COMBINED)} FROM (SELECT *, {_BOOSTS} FROM (SELECT event_id, CAST(event_id % 128 AS DOUBLE) / 128 AS c,
 event_id % 4 AS papers, user_id % 5 AS web FROM events))""")(
    lambda w: rounded(w["events"].select(
        "event_id", *R.route((F.col("event_id") % 128) / 128.0, F.col("event_id") % 4, F.col("user_id") % 5)),
        {"combined_confidence": 6}))
job("j6_golden_match", f"""
SELECT query_id, golden_id, ground_truth_answer, {rnd('score', 6)} AS score FROM (SELECT q.id AS query_id, g.golden_id, g.ground_truth_answer,
 {_COS.format("q.embedding", "g.question_embedding")} AS score FROM text_vectors q CROSS JOIN golden g
 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY score DESC, g.golden_id) = 1) WHERE score > 0.85""")(
    lambda w: rounded(R.golden_matches(w["text_vectors"].withColumnRenamed("id", "query_id"), w["golden"]), {"score": 6}))


def catalogue(w):
    """The described tables, each with a mean vector standing in for its description's."""
    rows = [(i, *r) for i, r in enumerate(C.TABLE_CATALOGUE)]
    names = w.spark.createDataFrame(rows, "label int, table_name string, table_schema string, description string, columns_info string")
    means = w["embeddings"].select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    vectors = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        "label", F.col("v.x").alias("embedding"))
    return F.broadcast(names).join(vectors, "label")


job("j7_closest_table", f"""
SELECT q.id AS query_id, arg_max(m.table_name, ({_COS.format("q.embedding", "m.v")}, -m.label)) AS table_name
FROM text_vectors q CROSS JOIN (SELECT label, list(x ORDER BY i) AS v, CASE label WHEN 0 THEN 'USER_FEEDBACK' WHEN 1 THEN 'USERS'
  ELSE 'USER_ACQUISITION_EVENTS' END AS table_name FROM (SELECT label, i, {rnd("avg(x)", 6)} AS x FROM (SELECT label,
  unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) WHERE label < 3 GROUP BY label) m
GROUP BY q.id""")(
    lambda w: R.closest_table(w["text_vectors"].withColumnRenamed("id", "query_id"), catalogue(w)).select("query_id", "table_name"))
job("i10_source_context", f"""
SELECT query_id, count(*) AS n_sources, string_agg(tier || ' ' || kind || ': ' || source_text, chr(10) ORDER BY
 CASE tier WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 2 ELSE 4 END + (kind = 'image')::INT, place) AS context
FROM (SELECT h.*, CASE kind WHEN 'text' THEN {_TEXT_TIER} ELSE {_IMAGE_TIER} END AS tier,
 CASE kind WHEN 'text' THEN d.text ELSE d.source END AS source_text FROM hits h JOIN documents d ON d.doc_id = h.id) GROUP BY query_id""")(
    lambda w: R.source_context(hits(w), w["documents"].select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("source_text")).unionByName(
        w["documents"].select(F.lit("image").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("source_text")))))

# -- evaluation ------------------------------------------------------------------------------

V["parsed_replies"] = """
SELECT log_id, CASE WHEN correctness_reply IS NULL THEN NULL ELSE CAST(regexp_extract(correctness_reply, '0[.][0-9]+') AS DOUBLE) END AS corr,
 CASE faithfulness_reply WHEN '1.0' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS faith, CASE relevancy_reply WHEN 'none' THEN 0::DOUBLE ELSE 0.75::DOUBLE END AS rel,
 1::DOUBLE AS ctx FROM judge_replies"""
_MEAN = "CASE WHEN corr IS NULL THEN (faith + rel + ctx) / 3 ELSE (corr + faith + rel + ctx) / 4 END"
job("j8_judge_scores", "SELECT log_id, corr AS correctness_score, faith AS faithfulness_score, rel AS relevancy_score, ctx AS context_quality_score FROM parsed_replies")(
    lambda w: E.scored_replies(w["judge_replies"]).drop("overall_score"))
job("j9_overall_score", f"SELECT log_id, {rnd(_MEAN, 6)} AS overall_score FROM parsed_replies")(
    lambda w: rounded(E.scored_replies(w["judge_replies"]).select("log_id", "overall_score"), {"overall_score": 6}))
job("j10_updated_logs", f"""
SELECT l.log_id, CASE WHEN l.overall_score IS NULL THEN p.faith ELSE l.faithfulness_score END AS faithfulness_score,
 CASE WHEN l.overall_score IS NULL THEN p.corr ELSE l.correctness_score END AS correctness_score,
 {rnd(f"CASE WHEN l.overall_score IS NULL THEN {_MEAN} ELSE l.overall_score END", 6)} AS overall_score
FROM evaluation_logs l LEFT JOIN parsed_replies p USING (log_id)""")(
    lambda w: rounded(E.apply_scores(w["evaluation_logs"], E.scored_replies(w["judge_replies"])).select(
        "log_id", "faithfulness_score", "correctness_score", "overall_score"), {"overall_score": 6}))
job("f10_latest_logs", "SELECT log_id, question, overall_score::DOUBLE AS overall_score FROM evaluation_logs ORDER BY logged_at DESC, log_id LIMIT 50")(
    lambda w: E.latest_logs(w["evaluation_logs"]).select("log_id", "question", F.col("overall_score").cast("double")))
job("f10_pending_logs", "SELECT log_id, question FROM evaluation_logs WHERE overall_score IS NULL ORDER BY logged_at, log_id LIMIT 5")(
    lambda w: E.pending_logs(w["evaluation_logs"]).select("log_id", "question"))
job("f11_recent_results", """
SELECT result_id, CASE WHEN risk_level IS NULL THEN 'subtype' ELSE 'risk' END AS result_type FROM results ORDER BY stored_at DESC, result_id DESC LIMIT 10""")(
    lambda w: E.recent_results(w["results"]).select("result_id", "result_type"))
job("j11_logged_contexts", """
SELECT q.query_id, list_aggregate(list_concat(q.texts, [substring(d.text, 1, 500)]), 'string_agg', '|') AS contexts
FROM (SELECT query_id, list(d.text ORDER BY place) AS texts FROM text_hits h JOIN documents d ON d.doc_id = h.id WHERE place <= 3 GROUP BY query_id) q
JOIN documents d ON d.doc_id = q.query_id""")(
    lambda w: text_hits(w).where("place <= 3").join(
        w["documents"].select(F.col("doc_id").alias("id"), "text"), "id").groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"))
    .join(w["documents"].select(F.col("doc_id").alias("query_id"), "text"), "query_id")
    .select("query_id", F.array_join(E.logged_contexts(F.col("texts"), F.col("text"), F.lit(None).cast("string")), "|").alias("contexts")))
job("j12_interaction_stats", """
SELECT log_id, CAST(round(seconds * 1000) AS BIGINT) AS response_ms, n_text + n_images > 0 AS has_sources FROM interactions""")(
    lambda w: E.interaction_stats(w["interactions"].withColumn("answered_at", F.timestamp_micros(
        F.unix_micros(F.col("asked_at").cast("timestamp")) + F.round(F.col("seconds") * 1e6).cast("bigint"))))
    .select("log_id", "response_ms", "has_sources"))
job("a18_new_log_rows", "SELECT log_id, question, " + ", ".join(
    f"NULL::DOUBLE AS {n}" for n in [*E.METRICS, "overall_score"]) + " FROM interactions")(lambda w: E.new_log_rows(w["interactions"].select("log_id", "question")))
job("a17_note_parts", """
SELECT conv_id, CAST(turn // 4 AS INT) AS part, '[' || string_agg(json_object('role', role, 'content', content)::VARCHAR, ',' ORDER BY turn) || ']' AS chat_history,
 count(*) FILTER (role = 'user') AS user_turns FROM chat_turns GROUP BY conv_id, turn // 4""")(
    lambda w: E.note_parts(w["chat_turns"], per_part=4))
job("a17_note_turns", """
SELECT conv_id, CAST(turn // 4 AS INT) AS part, CAST(turn % 4 AS INT) AS turn_in_part, role, content FROM chat_turns""")(
    lambda w: E.note_turns(E.note_parts(w["chat_turns"], per_part=4)))
V["chat_notes"] = """
SELECT conv_id AS note_id, CAST(conv_id % 50 AS INT) AS user_id, DATE '2024-01-01' + CAST(conv_id * 37 % 365 AS INT) AS created_at,
 count(*) FILTER (role = 'user') AS total_queries FROM chat_turns GROUP BY conv_id"""


def chat_notes(w):
    """One note per chat, with its owner and day."""
    return w["chat_turns"].groupBy(F.col("conv_id").alias("note_id")).agg(F.count_if(F.col("role") == "user").alias("total_queries")).select(
        "note_id", (F.col("note_id") % 50).cast("int").alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("note_id") * 37 % 365).cast("int")).alias("created_at"), "total_queries")


job("a17_notes_of_user", "SELECT * FROM chat_notes WHERE user_id = 7 ORDER BY created_at DESC, note_id")(lambda w: E.notes_of(chat_notes(w), 7))
job("d28_user_turns", "SELECT conv_id, count(*) FILTER (role = 'user') AS total_queries FROM chat_turns GROUP BY conv_id")(
    lambda w: E.user_turns(w["chat_turns"]))
job("d30_feedback_by_day", f"""
SELECT feedback_date, count(*) AS n, {rnd("avg(rating)", 6)} AS avg_rating FROM feedback GROUP BY feedback_date""")(
    lambda w: rounded(w["feedback"].groupBy("feedback_date").agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating")), {"avg_rating": 6}))
job("d30_feedback_ratings", "SELECT rating, count(*) AS n FROM feedback GROUP BY rating")(
    lambda w: w["feedback"].groupBy("rating").agg(F.count("*").alias("n")))
job("q2_repeated_keys", " UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, count(*) AS copies FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1"
    for t, k in [("users", "username"), ("users", "email"), ("image_vectors", "image_hash"), ("text_processed", "paper_id")]))(
    lambda w: quality.repeated_keys(w["users"], "username").unionByName(quality.repeated_keys(w["users"], "email"))
    .unionByName(quality.repeated_keys(w["image_vectors"], "image_hash")).unionByName(
        quality.repeated_keys(w["text_processed"], "paper_id")))
job("q3_null_counts", """
SELECT 'users' AS table_name, 'first_name' AS column_name, count(*) FILTER (first_name IS NULL) AS null_rows FROM users UNION ALL
SELECT 'users', 'username', count(*) FILTER (username IS NULL) FROM users UNION ALL
SELECT 'papers', 'title', count(*) FILTER (title IS NULL) FROM papers UNION ALL
SELECT 'papers', 'pmc_id', count(*) FILTER (pmc_id IS NULL) FROM papers""")(
    lambda w: quality.null_counts(w["users"], "users", ["first_name", "username"]).unionByName(
        quality.null_counts(w["papers"], "papers", ["title", "pmc_id"])))
