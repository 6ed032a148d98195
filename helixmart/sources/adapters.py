"""Views that give the driver's tables the shape of the landed tables.

Each text is valid in Spark SQL and in DuckDB, so the same words feed the job
and its check. Modulo arithmetic only invents column values; no row is left out.
"""

ADAPTERS: dict[str, str] = {}

ADAPTERS["clinical_data"] = """
SELECT c_mktsegment AS study_id, ' p' || CAST(c_custkey AS STRING) AS patient_id,
 CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE ' s' || CAST(c_custkey AS STRING) || ' ' END AS sample_id,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey*37) % 600 END AS mutation_count,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey*13) % 240 AS DOUBLE)/8 END AS tmb_nonsynonymous,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey*7) % 480 AS DOUBLE)/8 END AS overall_survival_months,
 CASE c_custkey % 3 WHEN 0 THEN '1:DECEASED' WHEN 1 THEN '0:LIVING' END AS overall_survival_status,
 CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
 CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 35 + (c_custkey*29) % 55 END AS diagnosis_age,
 CASE c_custkey % 5 WHEN 0 THEN 'Current smoker' WHEN 1 THEN 'Former smoker' END AS smoker,
 CASE c_custkey % 7 WHEN 0 THEN 'Never smoked' WHEN 1 THEN 'Current' END AS smoking_history,
 CASE c_custkey % 6 WHEN 0 THEN 'I' WHEN 1 THEN 'IIB' WHEN 2 THEN 'IIIA' WHEN 3 THEN 'IV' WHEN 4 THEN 'Limited' END AS stage_at_diagnosis,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'SCLC' END AS oncotree_code,
 CASE c_custkey % 5 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4' END AS t_stage,
 CASE c_custkey % 4 WHEN 0 THEN 'N0' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' END AS n_stage,
 CASE c_custkey % 3 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1' END AS m_stage
FROM customer
"""

ADAPTERS["gene_expression"] = """
SELECT CASE l_partkey % 16 WHEN 0 THEN 'ascl1' WHEN 1 THEN ' NEUROD1' WHEN 2 THEN 'POU2F3' WHEN 3 THEN 'YAP1'
  WHEN 4 THEN 'TP53' WHEN 5 THEN 'RB1' WHEN 6 THEN 'MYC' WHEN 7 THEN 'MYCL' WHEN 8 THEN 'MYCN' WHEN 9 THEN 'DLL3'
  WHEN 10 THEN 'BCL2' WHEN 11 THEN 'NOTCH1' ELSE 'GENE' || CAST(l_partkey % 16 AS STRING) END AS gene_symbol,
 's' || CAST(o_custkey AS STRING) AS sample_id,
 CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity * CAST(l_suppkey % 5 + 1 AS DOUBLE) / 16 END AS expression_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

ADAPTERS["compounds"] = """
SELECT CAST(p_partkey AS STRING) AS nsc, ' 50-' || CAST(p_size AS STRING) AS cas,
 CASE p_partkey % 40 WHEN 0 THEN 'Venetoclax' WHEN 1 THEN 'Rovalpituzumab tesirine' ELSE p_name END AS drug_name
FROM part
"""

ADAPTERS["cell_lines"] = """
SELECT CASE s_suppkey WHEN 0 THEN 'H69' WHEN 1 THEN 'H1048' WHEN 2 THEN 'H1339' WHEN 3 THEN 'H446' WHEN 4 THEN 'H82'
  WHEN 5 THEN 'H1963' WHEN 6 THEN 'H1450' WHEN 7 THEN 'H1672' WHEN 8 THEN 'DMS 273' WHEN 9 THEN ' h69 '
  WHEN 10 THEN 'H2171' WHEN 11 THEN 'H209' ELSE 'CL' || CAST(s_suppkey AS STRING) END AS cell_line,
 CASE WHEN s_suppkey < 14 THEN 'Small Cell Lung Cancer' ELSE 'Panel ' || CAST(s_nationkey AS STRING) END AS panel
FROM supplier
"""

ADAPTERS["experiments"] = """
SELECT CAST(o_orderkey AS STRING) AS experiment_id, CAST(o_custkey AS STRING) AS nsc,
 '-4.0' AS highest_tested_concentration,
 CASE o_orderkey % 14 WHEN 0 THEN ' h69' WHEN 1 THEN 'H1048' WHEN 2 THEN 'H1339' WHEN 3 THEN 'h446 ' WHEN 4 THEN 'H82'
  WHEN 5 THEN 'H1963' WHEN 6 THEN 'H1450' WHEN 7 THEN 'H1672' WHEN 8 THEN 'DMS 273' WHEN 9 THEN 'CL9'
  WHEN 10 THEN 'H2171' WHEN 11 THEN 'H209' WHEN 12 THEN 'CL12' END AS cell_line,
 '-5.5' AS log_ec50, '100' AS response_zero, CAST(o_orderkey % 100 AS STRING) AS response_inflection,
 '-1.25' AS hill_slope,
 CASE WHEN o_orderkey % 23 = 0 THEN 'NA' ELSE '-' || CAST(3 + (o_custkey + o_orderkey % 3) % 6 AS STRING) || '.'
  || CAST(o_orderkey % 10 AS STRING) END AS log_ic50, ' F ' AS flag_ic50
FROM orders
"""

ADAPTERS["dose_response"] = """
SELECT l_orderkey AS experiment_id, l_extendedprice / 65536 AS concentration, l_quantity * 2 AS mean_pct_ctrl,
 CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity * CAST(l_partkey % 9 AS DOUBLE) / 8 END AS stddev_pct_ctrl,
 CAST(l_linenumber AS BIGINT) AS count_pct_ctrl
FROM lineitem
"""

ADAPTERS["papers"] = """
SELECT 'PMC' || CAST(doc_id AS STRING) AS pmc_id,
 CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang || ' report ' || CAST(doc_id AS STRING) END AS title,
 text AS abstract, source AS authors, '10.1/' || CAST(doc_id AS STRING) AS doi,
 's3://papers/PMC' || CAST(doc_id AS STRING) || '.pdf' AS s3_url
FROM documents
"""

ADAPTERS["text_processed"] = """
SELECT 'PMC' || CAST(doc_id AS STRING) AS paper_id, 1 AS text_chunks_count FROM labels WHERE quality = 1
"""

ADAPTERS["images_processed"] = """
SELECT 'PMC' || CAST(doc_id AS STRING) AS paper_id, 1 AS images_count FROM labels WHERE toxic = 1
"""

ADAPTERS["text_vectors"] = """
SELECT vec_id AS id, 'PMC' || CAST(vec_id AS STRING) AS paper_id, label AS chunk_index, embedding FROM embeddings
"""

ADAPTERS["image_vectors"] = """
SELECT vec_id AS id, 'PMC' || CAST(vec_id % 100 AS STRING) AS paper_id, label + 1 AS page_number,
 CAST(floor(vec_id / 100) AS INT) AS image_index, 'h' || CAST(vec_id % 180 AS STRING) AS image_hash,
 64 + label AS width, 48 + label AS height, 'png' AS format, embedding
FROM embeddings
"""

ADAPTERS["query_vectors"] = """
SELECT item_id AS query_id, text AS question, embedding FROM benchmark JOIN embeddings ON vec_id = item_id
"""

ADAPTERS["golden"] = """
SELECT item_id AS golden_id, text AS ground_truth_answer, embedding AS question_embedding
FROM benchmark JOIN embeddings ON vec_id = item_id
"""

ADAPTERS["event_records"] = """
SELECT '{"CreateTime":' || CAST(1704067200000 + event_id * 250 AS STRING) || '}' AS record_metadata,
 '{"event_id":"' || CAST(event_id AS STRING) || '","user_id":"' || CASE WHEN event_id % 12 = 0 THEN 'anonymous'
  ELSE CAST(user_id AS STRING) END || '","session_id":"' || CAST(user_id AS STRING) || '-'
  || CAST(CAST(ts AS DATE) AS STRING) || '","event_type":"' || CASE event_type WHEN 'signup' THEN 'user_signup_success'
  WHEN 'view' THEN 'user_login_success' WHEN 'error' THEN 'user_login_failure' ELSE 'button_click' END
  || '","button_name":"' || CASE event_id % 4 WHEN 0 THEN 'find_centers' WHEN 1 THEN 'risk_quick_prediction'
  WHEN 2 THEN 'subtype_classify' ELSE 'submit_feedback' END || '","status":"' || CASE WHEN event_type = 'error'
  THEN 'failure' ELSE 'success' END || '","user_type":"user","timestamp":"' || CAST(CAST(ts AS DATE) AS STRING)
  || 'T' || substring(CAST(ts AS STRING), 12, 8) || 'Z"}' AS record_content
FROM events
"""

ADAPTERS["feedback"] = """
SELECT doc_id AS feedback_id, doc_id % 50 AS user_id, text AS feedback_text,
 CAST(1 + (doc_id + quality) % 5 AS INT) AS rating, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS feedback_date
FROM documents JOIN labels USING (doc_id)
"""

ADAPTERS["users"] = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 = 0 THEN 'u ' || CAST(c_custkey AS STRING)
  WHEN c_custkey % 31 = 0 THEN 'ab' ELSE replace(c_name, '#', '_') END AS username,
 CASE WHEN c_custkey % 8 = 0 THEN 'mail-' || CAST(c_custkey AS STRING) ELSE 'c' || CAST(c_custkey % 1400 AS STRING)
  || '@example.org' END AS email, c_mktsegment AS user_role,
 CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_name END AS first_name
FROM customer
"""

ADAPTERS["judge_replies"] = """
SELECT doc_id AS log_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Rating: 0.' || CAST(doc_id % 10 AS STRING)
  END AS correctness_reply, CASE quality WHEN 1 THEN '1.0' ELSE 'score 0.4' END AS faithfulness_reply,
 CASE toxic WHEN 1 THEN 'none' ELSE '0.75 out of 1' END AS relevancy_reply, '10' AS context_reply
FROM labels
"""

ADAPTERS["id_map"] = """
SELECT CAST(doc_id AS STRING) AS pmid, CASE WHEN toxic = 1 THEN NULL ELSE 'PMC' || CAST(doc_id AS STRING) END AS pmc_id
FROM labels
"""

ADAPTERS["sample_info"] = """
SELECT 'S' || CAST(c_custkey AS STRING) AS line_id, c_name AS cell_line_name,
 CASE c_custkey % 3 WHEN 0 THEN 'lung' WHEN 1 THEN 'breast' ELSE 'skin' END AS lineage,
 CASE c_custkey % 4 WHEN 0 THEN 'Small Cell Lung Cancer' WHEN 1 THEN 'Non-Small Cell Lung Cancer'
  WHEN 2 THEN 'Carcinoid' END AS primary_disease,
 CASE c_custkey % 5 WHEN 0 THEN 'SCLC' WHEN 1 THEN 'NSCLC' WHEN 2 THEN 'adenocarcinoma' END AS lineage_subtype
FROM customer
"""

ADAPTERS["matrix_genes"] = """
SELECT DISTINCT upper(trim(CASE l_partkey % 16 WHEN 0 THEN 'ascl1' WHEN 1 THEN ' NEUROD1' WHEN 2 THEN 'POU2F3'
  WHEN 3 THEN 'YAP1' WHEN 4 THEN 'TP53' WHEN 5 THEN 'RB1' WHEN 6 THEN 'MYC' WHEN 7 THEN 'MYCL' WHEN 8 THEN 'MYCN'
  WHEN 9 THEN 'DLL3' ELSE 'GENE' || CAST(l_partkey % 16 AS STRING) END)) || CASE WHEN l_partkey % 16 % 2 = 0
  THEN '' ELSE ' (ENSG' || CAST(l_partkey % 16 AS STRING) || ')' END AS column_name,
 CAST(l_partkey % 16 AS INT) AS position
FROM lineitem
"""

ADAPTERS["questions"] = """
SELECT event_id AS question_id, CASE event_id % 7 WHEN 0 THEN 'How many users joined this month'
  WHEN 1 THEN 'Average RATING by day' WHEN 2 THEN 'Which button is used most' WHEN 3 THEN 'Show login failures'
  WHEN 4 THEN 'User opinion on ' || event_type WHEN 5 THEN 'Total users by role' ELSE event_type || ' ' || props END AS question
FROM events
"""

ADAPTERS["landed_pages"] = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<meta name="citation_pdf_url" content="https://host.example/p' || CAST(page_id AS STRING)
  || '.pdf">' WHEN 1 THEN '<a class="int-view" href="/articles/v' || CAST(page_id AS STRING) || '.pdf">view</a>'
  WHEN 2 THEN '<a href="/articles/pdf/a' || CAST(page_id AS STRING) || '.pdf">file</a>'
  WHEN 3 THEN '<a href="https://mirror.example/pdf/b.pdf">mirror</a>' ELSE '' END || html AS html
FROM pages
"""

ADAPTERS["staged_vectors"] = """
SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN '[1.5,2.5]' WHEN 1 THEN 'not a vector' ELSE '[' || CAST(c_custkey % 7 AS STRING)
  || '.5,' || CAST(c_custkey % 3 AS STRING) || '.25,' || CAST(c_custkey % 5 AS STRING) || '.0]' END AS embedding_json
FROM customer
"""

ADAPTERS["generated_texts"] = """
SELECT c_custkey AS answer_id, 'Intro' || chr(10) || '1. RISK INTERPRETATION' || chr(10) || 'Risk of ' || c_name || ' in ' || c_mktsegment
 || chr(10) || '2. Short' || chr(10) || '3. **PROGNOSIS** for balance ' || CAST(c_nationkey AS STRING) || ' and more words' AS answer,
 '**1. Center ' || c_name || '**' || chr(10) || ' Street ' || CAST(c_nationkey AS STRING) || chr(10) || chr(10) || 'Type: NCI'
 || chr(10) || '**2.  ' || c_mktsegment || ' Clinic **' || chr(10) || 'Phone' AS centres,
 '```sql' || chr(10) || 'SELECT ' || CAST(c_custkey AS STRING) || chr(10) || '```' AS sql_reply,
 '```markdown' || chr(10) || 'Finding ' || c_name || chr(10) || '```' AS insight_reply
FROM customer
"""

ADAPTERS["evaluation_logs"] = """
SELECT doc_id AS log_id, CAST(DATE '2024-03-01' + CAST(doc_id % 90 AS INT) AS TIMESTAMP) AS logged_at, lang AS question, source AS generated_answer,
 CASE WHEN toxic = 1 THEN 0.25 END AS faithfulness_score, CASE WHEN toxic = 1 THEN 0.5 END AS relevancy_score,
 CASE WHEN toxic = 1 THEN 0.75 END AS context_quality_score, CAST(NULL AS DOUBLE) AS correctness_score,
 CASE WHEN toxic = 1 THEN 0.5 END AS overall_score
FROM documents JOIN labels USING (doc_id)
"""

ADAPTERS["results"] = """
SELECT event_id AS result_id, ts AS stored_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS risk_level FROM events
"""

ADAPTERS["interactions"] = """
SELECT event_id AS log_id, ts AS asked_at, event_type AS question, event_id % 4 AS n_text, user_id % 3 AS n_images, value AS seconds FROM events
"""

ADAPTERS["chat_turns"] = """
SELECT conv_id, turn, role, text AS content FROM conversations
"""

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
