"""Papers: pages, chunks with page spans, hashes, ledgers, ids and evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixmart.functions import constants as C
from helixmart.functions.rules import band
from helixmart.operators.lookups import mentions
from helixmart.operators.ranking import running_total

PAGE_CHARS = 3000


def split_pages(documents: DataFrame, id_column: Column, text: str = "text", page_chars: int = PAGE_CHARS) -> DataFrame:
    """paper_id and its pages as one array; text without page marks is cut every ``page_chars``."""
    size = F.length(text)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(page_chars))).otherwise(F.array(F.lit(0)))
    return documents.where(F.col(text).isNotNull()).select(
        id_column.alias("paper_id"),
        F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(page_chars))).alias("pages"))


def gather_pages(page_rows: DataFrame) -> DataFrame:
    """One row per page -> pages array per paper. A group is one file, so file size bounds it."""
    return page_rows.groupBy("paper_id").agg(
        F.sort_array(F.collect_list(F.struct("page_number", F.col("text")))).alias("_p")
    ).select("paper_id", F.col("_p.text").alias("pages"))


def page_rows(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", F.posexplode_outer("pages").alias("_i", "text")).select(
        "paper_id", (F.col("_i") + 1).alias("page_number"), "text", F.length("text").alias("char_count"))


def full_text(pages: Column) -> Column:
    """Page texts, each followed by a line break."""
    return F.concat(F.array_join(pages, "\n"), F.lit("\n"))


def chunk(papers: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks with offsets, page span and hashes, without a shuffle.

    Chunks are built inside the row of their paper and only then exploded, so the
    paper itself is not copied per chunk; each chunk is cut from the few pages it
    touches. The last window is always kept, even inside its predecessor.
    """
    step = size - overlap
    ends = F.aggregate(
        F.transform("pages", lambda p: F.length(p) + 1),
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    located = (
        papers.where(F.size("pages") > 0)
        .select("paper_id", "pages", full_text(F.col("pages")).alias("_full"), ends.alias("_ends"))
        .select("paper_id", "pages", "_ends", F.sha2("_full", 256).alias("content_hash"),
                F.length("_full").alias("_len"))
    )

    def place(start: Column) -> Column:
        end = F.least(start + size, F.col("_len"))
        return F.struct(
            start.alias("start"), end.alias("end"),
            (F.size(F.filter("_ends", lambda e: e <= start)) + 1).alias("first"),
            (F.size(F.filter("_ends", lambda e: e < end)) + 1).alias("last"))

    def cut(at: Column) -> Column:
        start, end, first, last = at["start"], at["end"], at["first"], at["last"]
        before = F.when(first > 1, F.element_at("_ends", F.greatest(first - 1, F.lit(1)))).otherwise(F.lit(0))
        piece = full_text(F.slice("pages", first, last - first + 1))
        return F.struct(
            (start / step).cast("int").alias("chunk_index"),
            F.substring(piece, start - before + 1, end - start).alias("chunk_text"),
            start.alias("start_char"), end.alias("end_char"),
            first.alias("start_page"), last.alias("end_page"), F.sequence(first, last).alias("pages_spanned"))

    starts = F.sequence(F.lit(0), F.col("_len") - 1, F.lit(step))
    # The outer form keeps the planner from repeating the whole expression in a filter;
    # every paper has at least one chunk, so it adds no row.
    return (
        located.select("paper_id", "content_hash", F.transform(F.transform(starts, place), cut).alias("_chunks"))
        .select("paper_id", "content_hash", F.explode_outer("_chunks").alias("c"))
        .select("paper_id", "c.*", "content_hash")
        .withColumn("chunk_hash", F.sha2("chunk_text", 256))
    )


def chunk_page_rows(pages: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, hashed: bool = False) -> DataFrame:
    """The same chunks from one row per page, without ever gathering a paper; ``hashed`` adds the paper's content_hash.

    Each page gives the piece it adds to every chunk it touches; a chunk then joins its
    few pieces. A paper with most of all pages is spread over tasks like any other rows.
    """
    step = size - overlap
    own = pages.withColumn("_n", F.length("text") + 1)
    placed = running_total(own.drop("text"), "paper_id", "page_number", "_n", "_begin").select(
        "paper_id", "page_number", "_begin")
    begin, end = F.col("_begin"), F.col("_begin") + F.col("_n")
    first = F.greatest(F.floor((begin - size) / step) + 1, F.lit(0))
    numbers = F.sequence(first.cast("int"), F.floor((end - 1) / step).cast("int"))
    start = F.col("chunk_index") * step
    low, high = F.greatest(start, begin), F.least(start + size, end)
    piece = F.substring(F.concat("text", F.lit("\n")), low - begin + 1, high - low)
    pieces = (
        own.join(placed, ["paper_id", "page_number"])
        .select("paper_id", "page_number", "text", "_n", "_begin", F.explode_outer(numbers).alias("chunk_index"))
        .select("paper_id", "page_number", "chunk_index", high.alias("_high"), piece.alias("_piece"))
    )
    joined = pieces.groupBy("paper_id", "chunk_index").agg(
        F.sort_array(F.collect_list(F.struct("page_number", "_piece"))).alias("_p"),
        F.max("_high").alias("_end"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"))
    chunks = joined.select(
        "paper_id", "chunk_index", F.array_join(F.col("_p._piece"), "").alias("chunk_text"),
        (F.col("chunk_index") * step).alias("start_char"), F.col("_end").cast("int").alias("end_char"),
        "start_page", "end_page", F.col("_p.page_number").alias("pages_spanned"),
    ).withColumn("chunk_hash", F.sha2("chunk_text", 256))
    return chunks.join(content_hashes(pages), "paper_id") if hashed else chunks


def content_hashes(pages: DataFrame) -> DataFrame:
    """(paper_id, content_hash) from one row per page: SHA-256 over the pages in order, each followed by a line break. Pages
    pass a task one after the other, so a paper is never held as a whole."""

    def digest(batches):
        paper, state, out = None, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for name, text in zip(part["paper_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if state is None or name != paper:
                        if state is not None:
                            out.append((paper, state.hexdigest()))
                        paper, state = name, hashlib.sha256()
                    state.update(f"{text or ''}\n".encode("utf-8", "surrogatepass"))
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["paper_id", "content_hash"])
                    out = []
        if state is not None:
            out.append((paper, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["paper_id", "content_hash"])

    ordered = pages.select(F.col("paper_id").cast("string").alias("paper_id"), "page_number", "text").repartition("paper_id").sortWithinPartitions(
        "paper_id", "page_number")
    return ordered.select("paper_id", "text").mapInArrow(digest, "paper_id string, content_hash string")


# -- ledgers ---------------------------------------------------------------------------------

def unprocessed(papers: DataFrame, ledger: DataFrame) -> DataFrame:
    return papers.join(ledger, papers["pmc_id"] == ledger["paper_id"], "left_anti")


def next_batch(papers: DataFrame, ledger: DataFrame, size: int = C.PAPER_BATCH) -> DataFrame:
    return unprocessed(papers, ledger).orderBy("pmc_id").limit(size)


def remaining_work(papers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Papers left, the rounds of PAPER_BATCH papers they take, whether these are more than one chain of runs may
    have, and what comes next."""
    left = unprocessed(papers, ledger).agg(F.count("*").alias("remaining"))
    rounds = F.ceil(F.col("remaining") / F.lit(float(C.PAPER_BATCH))).cast("bigint")
    return left.select(
        "remaining", rounds.alias("rounds"), (rounds > C.MAX_ROUNDS).alias("over_ceiling"),
        F.when(F.col("remaining") > 0, "trigger_next_run").otherwise("end_processing").alias("next_step"))


def per_paper(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("paper_id").agg(F.count("*").alias(name))


def text_ledger_rows(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Papers with stored chunks that the ledger lacks."""
    return per_paper(chunks, "text_chunks_count").join(ledger, "paper_id", "left_anti")


def image_ledger_rows(papers: DataFrame, images: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every paper not yet marked, also those without images."""
    return (
        unprocessed(papers, ledger).select(F.col("pmc_id").alias("paper_id"))
        .join(per_paper(images, "images_count"), "paper_id", "left")
        .select("paper_id", F.coalesce("images_count", F.lit(0)).cast("bigint").alias("images_count"))
    )


def unique_images(images: DataFrame) -> DataFrame:
    """First paper, page and index per image hash; a partial aggregate, so copies never meet unreduced."""
    first = F.min(F.struct("paper_id", "page_number", "image_index", "s3_url", "width", "height", "format"))
    return images.groupBy("image_hash").agg(first.alias("i")).select("image_hash", "i.*")


def image_rows(images: DataFrame, prefix: str = "s3://images/papers") -> DataFrame:
    key = F.concat(F.lit(prefix + "/"), F.col("paper_id"), F.lit("/page_"), F.col("page_number").cast("string"),
                   F.lit("_img_"), F.col("image_index").cast("string"), F.lit("."), F.col("format"))
    return images.withColumn("s3_url", key)


# -- ids and locations -----------------------------------------------------------------------

def unique_in_order(ids: DataFrame, column: str, position: str, limit: int | None = None) -> DataFrame:
    """Distinct ids in order of first appearance; with ``limit`` only the first of them (C.MAX_IDS in one ingest)."""
    unique = ids.groupBy(column).agg(F.min(position).alias(position)).orderBy(position)
    return unique if limit is None else unique.limit(limit)


def existing_ids(stored: DataFrame, wanted: DataFrame, column: str = "pmc_id") -> DataFrame:
    return stored.select(column).distinct().join(wanted.select(column), column, "left_semi")


def new_ids(wanted: DataFrame, stored: DataFrame, column: str = "pmc_id") -> DataFrame:
    return wanted.join(stored.select(column), column, "left_anti")


def with_repaired(papers: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Catalogued papers plus stored but uncatalogued ones under placeholder metadata."""
    pmc = F.col("pmc_id")
    missing = stored_ids.select("pmc_id").subtract(papers.select("pmc_id")).select(
        pmc, F.concat(F.lit("Paper "), pmc).alias("title"), F.lit("Metadata not available").alias("abstract"),
        F.lit("Unknown").alias("authors"), F.lit("Not available").alias("doi"),
        F.concat(F.lit("s3://papers/"), pmc, F.lit(".pdf")).alias("s3_url"))
    return papers.select("pmc_id", "title", "abstract", "authors", "doi", "s3_url").unionByName(missing)


def fetch_locations(ids: DataFrame, bucket: str = "papers", prefix: str = "pdf/") -> DataFrame:
    """Places to try per paper in order, and where the file is stored."""
    pmc = F.col("pmc_id")
    number = F.replace(pmc, F.lit("PMC"), F.lit(""))
    parts = {"{pre}": F.substring(number, 1, 2), "{num}": number, "{id}": pmc}

    def fill(pattern: str) -> Column:
        out = F.lit(pattern)
        for mark, value in parts.items():
            out = F.replace(out, F.lit(mark), value)
        return out

    return ids.select(
        "pmc_id", F.array(*[fill(p) for p in C.PAPER_LOCATIONS]).alias("locations"),
        F.concat(F.lit(f"s3://{bucket}/{prefix}"), pmc, F.lit(".pdf")).alias("stored_path"))


def extract_pdf_link(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """PDF link of a landed page: meta tag, then viewer link, then any /pdf/ link, then the usual pattern."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(html), pattern, 1), F.lit(""))

    meta = F.coalesce(
        found(r'(?i)<meta[^>]*name="citation_pdf_url"[^>]*content="([^"]*)"'),
        found(r'(?i)<meta[^>]*content="([^"]*)"[^>]*name="citation_pdf_url"'))
    link = F.coalesce(
        found(r'(?i)<a[^>]*class="int-view"[^>]*href="([^"]*)"'),
        found(r'(?i)<a[^>]*href="([^"]*)"[^>]*class="int-view"'),
        found(r'(?i)<a[^>]*href="([^"]*/pdf/[^"]*)"'))
    absolute = F.when(link.startswith("/"), F.concat(F.lit(C.PDF_SITE), link)).otherwise(link)
    usual = F.replace(F.lit(C.PDF_PATTERN), F.lit("{id}"), F.col(page_id).cast("string"))
    return pages.select(page_id, F.coalesce(meta, absolute, usual).alias("pdf_url"))


# -- evidence --------------------------------------------------------------------------------

def first_matching_chunk(chunks: DataFrame, terms: Sequence[str] = tuple(C.EVIDENCE_TERMS),
                         longer_than: int = C.EVIDENCE_MIN_CHARS) -> DataFrame:
    """First chunk per paper among those that mention a term; one aggregate instead of a sort."""
    hits = chunks.where(mentions(F.col("chunk_text"), list(terms), longer_than))
    return hits.groupBy("paper_id").agg(F.min_by("chunk_text", "chunk_index").alias("chunk_text"))


def sampled(rows: DataFrame, identity: str, seed: str, n: int = 5) -> DataFrame:
    """``n`` rows in the order of a seeded hash: random to the eye, equal on every run."""
    order = F.md5(F.concat(F.col(identity), F.lit(seed)).cast("binary"))
    return rows.withColumn("_o", order).orderBy("_o", identity).limit(n).drop("_o")


def evidence(chunks: DataFrame, seed: str = "evidence", terms: Sequence[str] = tuple(C.EVIDENCE_TERMS)) -> DataFrame:
    """Five papers with a 500-character chunk, a placed score 0.90 - 0.05 i and a 150-character line."""
    picked = sampled(first_matching_chunk(chunks, terms), "paper_id", seed)
    ordered = picked.agg(F.sort_array(F.collect_list(F.struct(
        F.md5(F.concat(F.col("paper_id"), F.lit(seed)).cast("binary")).alias("o"), "paper_id", "chunk_text"))).alias("p"))
    text = F.substring(F.col("x.chunk_text"), 1, 500)
    return ordered.select(F.posexplode("p").alias("i", "x")).select(
        (F.col("i") + 1).alias("place"), F.col("x.paper_id").alias("paper_id"), text.alias("chunk_text"),
        F.round(F.lit(0.9) - (F.col("i") + 1) * F.lit(0.05), 2).alias("similarity_score"),
        F.concat((F.col("i") + 1).cast("string"), F.lit(". ["), F.col("x.paper_id"), F.lit("]: "),
                 F.substring(text, 1, 150), F.lit("...")).alias("line"))


def evidence_summary(found: DataFrame) -> DataFrame:
    """One text over the (at most five) evidence lines."""
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    return found.agg(F.count("*").alias("n_papers"), lines.alias("l")).select(
        "n_papers",
        F.concat(F.lit("Key findings from "), F.col("n_papers").cast("string"), F.lit(" papers:\n"),
                 F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("summary"))


def search_phrase(score: Column) -> Column:
    """Phrase set by risk score. Carried as a column; the evidence search does not use it."""
    return band(score, C.SEARCH_PHRASES, C.SEARCH_PHRASE_REST)


# -- generated text --------------------------------------------------------------------------

def numbered_names(texts: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Entries written as **1. Name** with the body up to the next entry; with ``limit`` the first ones per text."""
    mark = r"\*\*(\d+)\.\s*([^\*]+?)\*\*"
    keys = [c for c in texts.columns if c != text]
    names = F.regexp_extract_all(F.col(text), F.lit(mark), F.lit(2))
    bodies = F.split(F.col(text), mark)
    bodies = F.slice(bodies, F.lit(2), F.size(bodies))
    pairs = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    pairs = pairs if limit is None else F.slice(pairs, 1, limit)
    return texts.select(*keys, F.posexplode(pairs).alias("i", "e")).select(
        *keys, (F.col("i") + 1).alias("entry"), F.trim("e.name").alias("name"),
        _stripped_lines(F.col("e.body")).alias("body"))


def _stripped_lines(body: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "<br>")


def numbered_sections(texts: DataFrame, text: str, longer_than: int = 20) -> DataFrame:
    """Sections after lines like "1. ", bold marks removed, short ones dropped: header and content."""
    keys = [c for c in texts.columns if c != text]
    parts = F.split(F.replace(F.col(text), F.lit("*"), F.lit("")), r"\n\d+\.\s*")
    body = F.regexp_replace(F.col("part"), r"^\s+|\s+$", "")
    cut = F.instr("section", "\n")
    return (
        texts.select(*keys, F.posexplode(parts).alias("i", "part"))
        .where(F.col("i") > 0)
        .select(*keys, F.col("i").alias("section_no"), body.alias("section"))
        .where(F.length("section") > longer_than)
        .select(
            *keys, "section_no",
            F.when(cut > 0, F.trim(F.substring_index("section", "\n", 1))).otherwise(F.col("section")).alias("header"),
            F.when(cut > 0, F.regexp_replace(F.expr("substring(section, instr(section, '\n') + 1)"), r"^\s+|\s+$", ""))
            .otherwise(F.col("section")).alias("content"))
    )


def tidy_sql(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("```sql"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def tidy_insight(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("```"), F.lit("")), F.lit("markdown"), F.lit(""))
    return F.regexp_replace(out, r"^\s+|\s+$", "")
