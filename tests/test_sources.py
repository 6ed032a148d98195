"""File readers on small hand-made files."""

import gzip
import struct

from pyspark.sql import functions as F

from helixmart.operators import profiling, stats
from helixmart.sources import files, sinks


def test_gzip_matrix(spark, tmp_path):
    header = ["gene"] + [f"T{i}" for i in range(86)]
    lines = ["\t".join(header)]
    for g in range(5):
        lines.append("\t".join([f"G{g}"] + [str(g + i / 10) for i in range(86)]))
    lines[2] = lines[2].replace("\t1.5\t", "\tNA\t", 1)
    lines += ["", "\t".join(["short", "1", "2"])]
    path = tmp_path / "m.tsv.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    long = files.read_expression_tsv(spark, str(path))
    assert long.count() == 5 * 86
    assert long.where("value IS NULL").count() == 1
    quality = stats.matrix_quality(long).first()
    assert (quality["n_genes"], quality["n_samples"], quality["missing_cells"]) == (5, 86, 1)
    groups = stats.sample_groups(long, F.col("position"))
    assert groups.where("sample_group = 'normal'").select("sample_id").distinct().count() == 7
    change = {r["gene_symbol"]: r for r in stats.fold_changes(groups).collect()}
    assert change["G0"]["regulated"] == "DOWN" and change["G0"]["direction"] == "DOWN"


def test_seed_and_wide_csv(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('"Study ID","Sample ID","Diagnosis Age"\nst,s1,061\n')
    row = files.load_seed(spark, str(tmp_path / "seed.csv")).first()
    assert row.asDict() == {"study_id": "st", "sample_id": "s1", "diagnosis_age": "061"}
    (tmp_path / "wide.csv").write_text(",ASCL1 (ENSG1),YAP1\nL1,1.5,x\nL2,,2\n")
    rows = {(r["line_id"], r["column_name"]): r["value"] for r in files.read_wide_csv(spark, str(tmp_path / "wide.csv")).collect()}
    assert rows == {("L1", "ASCL1 (ENSG1)"): 1.5, ("L1", "YAP1"): None, ("L2", "ASCL1 (ENSG1)"): None, ("L2", "YAP1"): 2.0}
    (tmp_path / "batch.csv").write_text("age,tmb\n61,2.5\nx,\n")
    batch = files.load_patients(spark, str(tmp_path / "batch.csv"), "age int, tmb double")
    assert profiling.profile(batch).first().asDict() == {"n_rows": 2, "n_columns": 2, "missing_cells": 2}


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<Set><PubmedArticle><ArticleTitle>T</ArticleTitle><AbstractText>A1</AbstractText><AbstractText>A2</AbstractText>"
        "<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><LastName>Solo</LastName></Author>"
        "<Author><LastName>Bare</LastName><ForeName></ForeName></Author><Author><LastName>Roe</LastName><ForeName>Al</ForeName></Author>"
        "</AuthorList></PubmedArticle></Set>")
    row = files.article_metadata(files.whole_texts(spark, str(tmp_path / "a.xml"))).drop("path").first()
    assert row.asDict() == {"title": "T", "abstract": "A1 A2", "authors": "Jo Doe, Bare, Al Roe", "doi": "No DOI available"}
    (tmp_path / "b.xml").write_text("<Set><PubmedArticle><ArticleId IdType='pmc'>1</ArticleId><ArticleId IdType='doi'>10.1/x</ArticleId>"
                                    "</PubmedArticle></Set>")
    row = files.article_metadata(files.whole_texts(spark, str(tmp_path / "b.xml"))).drop("path").first()
    assert row.asDict() == {"title": "No title", "abstract": "No abstract available", "authors": "No authors listed", "doi": "10.1/x"}


def test_feed_and_search_reply(spark, tmp_path):
    entry = "<entry><title> A\nB </title>{}<published>2024-05-06T00:00:00Z</published><summary>S</summary><id>http://h/abs/77v1</id></entry>"
    people = "".join(f"<author><name>N{i}</name></author>" for i in range(4))
    (tmp_path / "f.xml").write_text(f"<feed xmlns='http://www.w3.org/2005/Atom'>{entry.format(people)}<entry><id>x/1</id></entry></feed>")
    rows = files.feed_entries(files.whole_texts(spark, str(tmp_path / "f.xml"))).orderBy("entry_no").collect()
    assert (rows[0]["title"], rows[0]["authors"], rows[0]["published"], rows[0]["arxiv_id"]) == ("A B", "N0, N1, N2 et al.", "2024-05-06", "77v1")
    assert (rows[1]["title"], rows[1]["authors"], rows[1]["abstract"]) == ("Unknown", "Unknown", "No abstract")
    (tmp_path / "s.json").write_text('{"organic_results": [{"title": "t", "link": "l"}, {"snippet": "s"}]}')
    rows = files.search_results(files.whole_texts(spark, str(tmp_path / "s.json"))).orderBy("place").collect()
    assert [tuple(r)[1:] for r in rows] == [("t", "No description", "l"), ("Unknown Title", "s", "")]


def test_pdf_check_and_pages(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF" + b"x" * 997)
    (tmp_path / "small.pdf").write_bytes(b"%PDF" + b"x" * 995)
    (tmp_path / "page.pdf").write_bytes(b"<html>" + b"x" * 2000)
    found = files.check_pdf(files.binary_files(spark, str(tmp_path), "*.pdf"))
    valid = {r["path"].split("/")[-1]: r["is_valid"] for r in found.select("path", "is_valid").collect()}
    assert valid == {"good.pdf": True, "small.pdf": False, "page.pdf": False}

    def reader(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return ["one", "two"]

    pages, failed = files.read_pages(found, reader)
    assert {r["paper_id"]: r["pages"] for r in pages.collect()} == {"good": ["one", "two"], "small": ["one", "two"]}
    assert [(r["paper_id"], r["error"]) for r in failed.collect()] == [("page", "no PDF")]


def test_image_inventory(spark, tmp_path):
    folder = tmp_path / "PMC1"
    folder.mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9) + b"rest"
    (folder / "page_2_img_1.png").write_bytes(png)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 12
    (folder / "page_3_img_2.jpg").write_bytes(jpeg)
    rows = {r["page_number"]: r for r in files.image_inventory(files.binary_files(spark, str(tmp_path))).collect()}
    assert (rows[2]["paper_id"], rows[2]["image_index"], rows[2]["width"], rows[2]["height"], rows[2]["format"]) == ("PMC1", 1, 7, 9, "png")
    assert (rows[3]["width"], rows[3]["height"], rows[3]["format"]) == (6, 5, "jpeg")
    assert len(rows[2]["image_hash"]) == 64


def test_writes(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    assert sinks.materialise(df, str(tmp_path / "t"), ["i"]).count() == 2
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["i", "s"]


def test_wide_csv_of_many_columns(spark, tmp_path):
    names = [f"G{i} ({i})" for i in range(20_000)]
    quoted = ",".join(['""', '"A, first (1)"', *names])
    (tmp_path / "wide.csv").write_text(quoted + "\n" + "\n".join(",".join([f"L{r}", *[str(r + c) for c in range(20_001)]]) for r in range(3)) + "\nshort,7\n\n")
    long = files.read_wide_csv(spark, str(tmp_path / "wide.csv"))
    assert long.count() == 4 * 20_001
    rows = {(r["line_id"], r["column_name"]): r["value"] for r in long.where("column_name IN ('A, first (1)', 'G19999 (19999)')").collect()}
    assert rows == {("L0", "A, first (1)"): 0.0, ("L1", "A, first (1)"): 1.0, ("L2", "A, first (1)"): 2.0, ("short", "A, first (1)"): 7.0,
                    ("L0", "G19999 (19999)"): 20000.0, ("L1", "G19999 (19999)"): 20001.0, ("L2", "G19999 (19999)"): 20002.0, ("short", "G19999 (19999)"): None}
