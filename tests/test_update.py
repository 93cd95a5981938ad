"""Storage, sources and the update run over small folders."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from docspark import cli, storage, update
from docspark.config import Chunking, Retrieval, Window
from docspark.operators import answers, index, registry, retrieval
from docspark.sources import admin, files

READERS = {".txt": lambda content: [{"unit_type": "paragraph", "unit_index": i + 1, "text": t} for i, t in enumerate(content.decode().split("\n"))]}
CHUNKS = update.Chunk(config=Chunking(Window("leaf", 3, 5, 8, 1), Window("parent", 8, 12, 20, 2)))


def put(path, text, age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (time.time() - age, time.time() - age))


def test_update_from_files_to_answers(spark, tmp_path):
    corpus, layout = tmp_path / "corpus", storage.Layout(str(tmp_path / "state"))
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    put(corpus / "a" / "one.txt", words(40, "alpha"), 50)
    put(corpus / "b" / "two.txt", words(30, "beta") + "\n" + words(10, "gamma"), 50)
    put(corpus / "b" / "blank.txt", " \n ", 50)
    scan = update.Scan(roots=(str(corpus),), extensions=(".txt",), readers=READERS, nature_root=f"file:{corpus}", nature_marker="none")
    done = update.run_update(spark, layout, scan=scan, chunk=CHUNKS)
    assert done["scan_extract"]["extraction_status_counts"] == {"EXTRACTED": 2, "FAILED": 1}
    assert (done["chunk"]["processed"], done["chunk"]["failed"], done["index"]["processed"], done["index"]["failed"]) == (2, 0, 2, 0)
    rows = {r["filename"]: r for r in files.read_registry(spark, layout.registry).collect()}
    assert rows["one.txt"]["nature"] == "a" and rows["one.txt"]["index_status"] == "INDEXED" and rows["blank.txt"]["extraction_error"] == "empty extracted text"
    assert int(rows["one.txt"]["nb_chunks"]) == int(rows["one.txt"]["indexed_chunks"]) > 3
    # nothing has changed: nothing is hashed, chunked or embedded
    known = files.read_registry(spark, layout.registry)
    assert registry.to_hash(known, files.list_files(spark, [str(corpus)], (".txt",)).withColumnRenamed("path", "canonical_path")).count() == 0
    done = update.run_update(spark, layout, scan=scan, chunk=CHUNKS)
    assert (done["chunk"]["processed"], done["index"]["processed"], done["index"]["newly_embedded"]) == (0, 0, 0)
    # one file changes, one moves, one goes
    put(corpus / "a" / "one.txt", words(45, "alpha"))
    (corpus / "b" / "two.txt").rename(corpus / "b" / "moved.txt")
    (corpus / "b" / "blank.txt").unlink()
    done = update.run_update(spark, layout, scan=scan, chunk=CHUNKS)
    assert (done["chunk"]["processed"], done["index"]["processed"], done["index"]["touched"]) == (1, 1, 2)  # the old content's bucket and the new one's
    rows = {r["filename"]: r for r in files.read_registry(spark, layout.registry).collect()}
    assert rows["moved.txt"]["index_status"] == "INDEXED" and rows["blank.txt"]["extraction_status"] == "MISSING" and "two.txt" not in rows
    index_rows = storage.read_version(spark, layout.index)
    assert {r["source_id"] for r in index_rows.collect()} == {rows["one.txt"]["source_id"], rows["moved.txt"]["source_id"]}
    # answers filter by metadata and name their documents
    out = cli.main(["--root", layout.root, "ask", "gamma1 gamma2 gamma3", "--filter", "nature=b", "--no-parents"], spark)
    assert out["citations"][0]["filename"] and {c["nature"] for c in out["used_chunks"]} == {"b"} and out["mode"] == "recherche"
    # a source goes: its artifact, chunks and vectors go too
    (corpus / "a" / "one.txt").unlink()
    done = update.run_update(spark, layout, scan=scan, chunk=CHUNKS)
    assert (done["scan_extract"]["purged"], done["chunk"]["stale_removed"], done["index"]["stale_removed"]) == (1, 1, 1)
    # backup, damage, restore, reset
    backup = cli.main(["--root", layout.root, "backup", "--name", " first ", "--zip"], spark)
    assert backup.endswith("/backups/first") and admin.verify(spark, backup).isEmpty() and os.path.exists(f"{backup}.zip")
    with pytest.raises(FileExistsError):
        admin.export(spark, layout, "first")
    with pytest.raises(ValueError):
        admin.export(spark, layout, "x", folder=str(tmp_path))
    before = storage.read_version(spark, layout.index).count()
    storage.write_version(spark.createDataFrame([], update.INDEX_SCHEMA), layout.index)
    with pytest.raises(ValueError):
        admin.restore(spark, layout, backup)
    cli.main(["--root", layout.root, "restore", f"{backup}.zip", "--registry", "--yes"], spark)
    assert storage.read_version(spark, layout.index).count() == before > 0
    part = next(x for x in os.listdir(f"{backup}/index") if x.endswith(".parquet"))
    os.remove(f"{backup}/index/{part}")
    with pytest.raises(ValueError):
        admin.restore(spark, layout, backup, confirm=True)
    assert cli.main(["--root", layout.root, "reset", "index"], spark) == [layout.index] and len(os.listdir(layout.index)) > 0
    cli.main(["--root", layout.root, "reset", "index", "--yes"], spark)
    assert os.listdir(layout.index) == []
    with pytest.raises(ValueError):
        admin.reset(spark, [str(tmp_path)], layout.root, True)


def test_failed_conversions_keep_what_was_there(tmp_path):
    old, new = tmp_path / "raw" / "A.doc", tmp_path / "made" / "x" / "A.docx"
    put(old, "old")
    put(new, "before")

    def office(code=0, text="made", name="a.DOCX", stderr="", stdout=""):
        def run(command, **_):
            if text is not None:
                with open(f"{command[-2]}/{name}", "w") as f:
                    f.write(text)
            return type("Done", (), {"returncode": code, "stderr": stderr, "stdout": stdout})

        return run

    def late(*_, **__):
        raise files.subprocess.TimeoutExpired("soffice", 3)

    go = lambda run, **options: files.convert(str(old), str(new), run=run, **options)
    assert go(None) == ("SKIP", "up to date") and go(None, force=True, dry_run=True) == ("DRYRUN", "would convert")
    assert go(office(2, None, stdout="from stdout"), force=True) == ("FAIL", "exit 2: from stdout") and go(office(1, stderr="from stderr", stdout="x"), force=True)[1] == "exit 1: from stderr"
    assert go(late, force=True, timeout=3)[1] == "timeout after 3 s" and go(office(text=None), force=True)[1] == "no output" and go(office(text=""), force=True)[1] == "empty output"
    assert go(office(name="other.docx"), force=True)[0] == "FAIL" and new.read_text() == "before" and os.listdir(new.parent) == ["A.docx"]
    assert go(office(), force=True) == ("OK", "") and new.read_text() == "made" and os.listdir(new.parent) == ["A.docx"]


def test_from_legacy_file_to_cited_origin(spark, tmp_path, monkeypatch):
    """A .doc is converted, scanned with its origin and nature, indexed and cited by the origin; a file that goes before it is read is missing."""
    raw, layout = tmp_path / "raw", storage.Layout(str(tmp_path / "state"))
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    put(raw / "law" / "Old.doc", words(20, "legacy"), 50)
    put(raw / "law" / "own.docx", words(20, "modern"), 50)
    put(raw / "tax" / "gone.docx", "soon gone", 50)

    def office(command, **_):
        folder, source = command[-2], command[-1]
        with open(source) as a, open(f"{folder}/{os.path.basename(source).rsplit('.', 1)[0]}.docx", "w") as b:
            b.write(a.read())
        return type("Done", (), {"returncode": 0, "stderr": "", "stdout": ""})

    whole, listed = files.run_conversion, files.scan_corpus
    monkeypatch.setattr(files, "run_conversion", lambda *a: whole(*a, run=office))

    def scan_then_lose(*a):
        found = storage.materialize(listed(*a), "scan")
        (raw / "tax" / "gone.docx").unlink(missing_ok=True)
        return found

    monkeypatch.setattr(files, "scan_corpus", scan_then_lose)
    step = update.Scan(roots=(str(raw),), extensions=(".docx",), readers={".docx": READERS[".txt"]}, nature_root=f"file:{raw}", nature_marker="none")
    done = update.run_update(spark, layout, update.Convert(True, str(raw)), step, CHUNKS, update.Index(ledger=f"{tmp_path}/ledger"))
    assert done["convert"]["OK"] == 1 and done["scan_extract"]["extraction_status_counts"] == {"EXTRACTED": 2, "MISSING": 1}
    rows = {r["filename"]: r for r in files.read_registry(spark, layout.registry).collect()}
    assert rows["Old.docx"]["origin_path"].endswith("/raw/law/Old.doc") and rows["Old.docx"]["canonical_path"].endswith("/state/converted/law/Old.docx") and rows["Old.docx"]["nature"] == "law"
    assert rows["own.docx"]["origin_path"] == rows["own.docx"]["canonical_path"] and rows["gone.docx"]["extraction_error"] == update.GONE and rows["gone.docx"]["chunk_status"] == ""
    out = cli.main(["--root", layout.root, "ask", "legacy1 legacy2 legacy3", "--no-parents"], spark)
    assert out["citations"][0]["path"].endswith("/raw/law/Old.doc")
    # the legacy file goes: its converted file is stale and goes too
    (raw / "law" / "Old.doc").unlink()
    done = update.run_update(spark, layout, update.Convert(True, str(raw)), step, CHUNKS)
    assert done["convert"]["stale_removed"] == 1 and done["index"]["stale_removed"] == 1 and {r["source_id"] for r in storage.read_version(spark, layout.index).collect()} == {rows["own.docx"]["source_id"]}


def test_known_paths_of_equal_content_stay(spark):
    fields = "source_id string, content_hash string, canonical_path string, size_bytes string, modified_time string, extraction_status string"
    known = registry.normalize_registry(spark.createDataFrame([("h", "h", "a", "1", "t", "EXTRACTED"), ("h", "h", "b", "1", "t", "EXTRACTED"), ("g", "g", "m", "1", "t", "EXTRACTED")], fields))
    scan = spark.createDataFrame([("a", "h", "1"), ("b", None, "1"), ("m", "g", "1"), ("k", "g", "1"), ("z", "n", "1"), ("y", "n", "1")], "canonical_path string, content_hash string, size_bytes string")
    scan = scan.withColumns({"filename": F.lit("f"), "nature": F.lit("n"), "ext": F.lit(".pdf"), "origin_path": F.lit("o"), "modified_time": F.lit("t"), "seen_at": F.lit("now"), "artifact_exists": F.lit(True)})
    got = sorted((r["canonical_path"], r["content_hash"], r["extraction_status"]) for r in registry.reconcile(known, scan).collect())
    assert got == [("a", "h", "EXTRACTED"), ("b", "h", "EXTRACTED"), ("m", "g", "EXTRACTED"), ("z", "n", "NEW")]
    later = scan.where("canonical_path = 'm'").unionByName(scan.where("canonical_path = 'k'").withColumn("canonical_path", F.lit("q")))
    got = sorted((r["canonical_path"], r["content_hash"], r["extraction_status"]) for r in registry.reconcile(known.where("source_id = 'g'"), later).collect())
    assert got == [("q", "g", "EXTRACTED")]


def test_targets_by_branch(spark):
    base = {"extraction_status": "EXTRACTED", "chunk_status": "CHUNKED", "chunk_config_hash": "c", "index_status": "INDEXED", "index_config_hash": "c", "indexed_chunks": "2", "nb_chunks": "2"}
    cases = {"ok": {}, "new": {"extraction_status": "NEW"}, "unchunked": {"chunk_status": "PENDING"}, "config": {"chunk_config_hash": "x", "index_config_hash": "x"}, "count": {"indexed_chunks": "1"}, "unindexed": {"index_status": ""}, "lost": {}, "": {"chunk_status": "PENDING"}}
    rows = registry.normalize_registry(spark.createDataFrame([base | {"source_id": k} | v for k, v in cases.items()]))
    have = spark.createDataFrame([(k,) for k in cases if k != "lost"], "source_id string")
    ids = lambda df: {r["source_id"] for r in df.collect()}
    assert ids(registry.chunk_targets(rows, have, "c")) == {"unchunked", "config", "lost"}
    assert ids(registry.index_targets(rows, have, "c")) == {"config", "count", "unindexed", "lost"}
    assert ids(registry.chunk_targets(rows, have, "c", force=True)) == set(cases) - {"new", ""}
    assert ids(registry.chunk_targets(rows, have, "c", sources=["lost", " config "])) == {"lost", "config"} and ids(registry.index_targets(rows, have, "c", limit=2)) == {"config", "count"}
    assert ids(registry.purge_chunks(have, rows)) == set(cases) - {"new", "lost"}
    assert ids(registry.orphan_sources(spark.createDataFrame([("ok",), ("stray",)], "source_id string"), rows)) == {"stray"}


def test_flatten_filters_and_context(spark):
    leaves = spark.createDataFrame([("c1", "s", "some text", 3, "7")], "chunk_id string, source_id string, text string, token_count int, start_char string")
    sources = spark.createDataFrame([("s", "f.pdf", "law")], "source_id string, filename string, nature string")
    row = index.flatten(leaves, sources, "m").first()
    assert (row["filename"], row["nature"], row["start_char"], row["level"], row["parent_id"], row["embedding_model"]) == ("f.pdf", "law", 7, "leaf", "", "m") and len(row) == 4 + len(index.TEXT_FIELDS) + len(index.NUMBER_FIELDS)
    bad = leaves.withColumn("text", F.lit(" "))
    assert index.flatten(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="leaf without"):
        index.flatten(bad).collect()
    cells = {c: F.lit(v) for c, v in {"source_id": "s", "filename": "f", "nature": "n", "ext": ".pdf", "unit_type_start": "page", "unit_index_start": "4", "chunk_id": "c", "text": "body"}.items()}
    block = spark.range(1).select(retrieval.context_block(F.lit(2), cells)).first()[0]
    assert block == "[C2]\nsource_id: s\nfilename: f\nnature: n\next: .pdf\nunit: page 4\nchunk_id: c\ntext:\nbody\n"
    assert retrieval.context_budget(Retrieval(), 400) == 4600 and retrieval.context_budget(Retrieval(), 9000) == 300


def test_citation_fields(spark):
    kinds = "qid int, rank int, chunk_id string, origin string, score double, retrieval_score double, distance double, expanded_from string, expanded_depth int, unit_type_start string, unit_index_start string, unit_type_end string, origin_path string"
    context = spark.createDataFrame([(1, 1, "a", "seed", 0.12345678, -0.5, 0.5, None, None, "page", "3", "", None), (1, 2, "b", "expanded", 0.1, None, None, "a", 1, "page", "x", "page", "/p")], kinds)
    replies = spark.createDataFrame([(1, "see [C2] [C1]"), (2, "no label")], "qid int, answer string")
    got = {r["qid"]: r for r in answers.finish(replies, context).collect()}
    b, a = got[1]["citations"]
    assert (b["label"], b["expanded_from_label"], b["expanded_depth"], b["score"], b["path"], b["unit_index"], b["unit_type_end"]) == ("C1", "C2", 1, None, "/p", 0, "page")
    assert (a["label"], a["score"], a["retrieval_score"], a["retrieval_distance"], a["expanded_depth"], a["unit_index"], a["unit_type_end"], a["path"]) == ("C2", 0.123457, -0.5, 0.5, None, 3, None, "")
    assert got[2]["citations"] == got[2]["used_chunks"] == []
    text = answers.as_json(answers.finish(replies, context), spark.createDataFrame([(1, "q")], "qid int, question string"), "resume", "m").first()["json"]
    assert json.loads(text)["query"] == "q" and "unit_type_end" not in json.loads(text)["citations"][1]


def test_sources(spark, tmp_path):
    put(tmp_path / "raw" / "x" / "Old.DOC", "1")
    put(tmp_path / "raw" / "~$lock.doc", "2")
    put(tmp_path / "raw" / "~$kept.pdf", "2")
    assert [r["filename"] for r in files.legacy_files(spark, str(tmp_path / "raw")).collect()] == ["Old.DOC"]
    assert [r["filename"] for r in files.list_files(spark, [str(tmp_path / "raw")] * 2).collect()] == ["~$kept.pdf"]
    put(tmp_path / "made" / "stale.docx", "x")

    def office(command, **_):
        folder, source = command[-2], command[-1]
        with open(f"{folder}/{os.path.basename(source).rsplit('.', 1)[0]}.docx", "w") as f:
            f.write("made")
        return type("Done", (), {"returncode": 0, "stderr": "", "stdout": ""})

    raw, made = str(tmp_path / "raw"), str(tmp_path / "made")
    dry, _ = files.run_conversion(spark, raw, made, dry_run=True, keep_stale=True, run=office)
    assert registry.conversion_summary(dry).first().asDict() == {"OK": 0, "SKIP": 0, "FAIL": 0, "DRYRUN": 1}
    done, removed = files.run_conversion(spark, raw, made, run=office)
    assert [(r["status"], r["destination"]) for r in done.collect()] == [("OK", f"{made}/x/Old.docx")] and removed == 1 and os.listdir(made) == ["x"]
    assert files.run_conversion(spark, raw, made, run=office)[0].first()["status"] == "SKIP"
    put(tmp_path / "lines" / "good.jsonl", '{"a": 1}\n\n[2]\n"x"\n{"a": 3}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "lines" / "good.jsonl"), "a int").collect()) == [1, 3]
    put(tmp_path / "lines" / "bad.jsonl", '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match=r"bad.jsonl:2"):
        files.read_jsonl(spark, str(tmp_path / "lines" / "bad.jsonl"), "a int").collect()
    assert admin.backup_name(" n ") == "n" and admin.backup_name("", 0) == "19700101T000000Z"


def test_options():
    assert cli.parser().parse_args(["--root", "r", "ask", "q", "--parents"]).parents is True
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--root", "r", "ask", "q", "--parents", "--no-parents"])


def test_log_is_made_once(tmp_path):
    log = cli.logger("docspark-test", str(tmp_path / "logs" / "x.log"))
    assert cli.logger("docspark-test", "elsewhere") is log and len(log.handlers) == 2
    log.info("hello")
    assert "| INFO | hello" in (tmp_path / "logs" / "x.log").read_text()


def test_update_command_logs_its_steps(spark, tmp_path):
    put(tmp_path / "corpus" / "a.pdf", "x")
    said = cli.main(["--root", str(tmp_path / "tables"), "update", "--corpus", str(tmp_path / "corpus"), "--scan-only"], spark)
    assert said["scan_extract"]["extraction_status_counts"] == {"NEW": 1}
    lines = (tmp_path / "tables" / "logs" / "update.log").read_text().splitlines()
    assert len(lines) == 1 and "| INFO | scan_extract | " in lines[0] and '"NEW": 1' in lines[0]


def test_statuses_of_other_hands_are_counted(spark, tmp_path):
    layout = storage.Layout(str(tmp_path))
    rows = spark.createDataFrame([{"source_id": str(i), "extraction_status": s} for i, s in enumerate(["NEW", "NEW", "ODD", "FAILED"])], "source_id string, extraction_status string")
    commit = storage.Commit(spark, layout.root)
    assert update._publish(commit, rows, "extraction_status") == {"NEW": 2, "ODD": 1, "FAILED": 1}
