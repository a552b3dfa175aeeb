import bz2
import io
import tarfile

from loglattice.plans.engine import EngineConfig, LogEngine
from loglattice.sources import artifacts


def test_engine_end_to_end(spark, tmp_path):
    lines = [f"2024-01-{i % 28 + 1:02d} host app: job {i} took {i * 7 % 13}ms, code={i % 3}" for i in range(300)] + ["", "odd one", "  x "]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    engine = LogEngine(spark, EngineConfig(head_length=2, kernel="zstd"))
    log = engine.read(str(tmp_path / "a.log")).cache()
    facts = engine.evaluate(log, str(tmp_path / "archive"))
    assert facts["score"] == 1.0 and facts["ratio"] > 3
    back = engine.restore(str(tmp_path / "archive"))
    assert [r.line for r in back.orderBy("rec_no").collect()] == lines
    encoded, _, found = artifacts.read_archive(spark, str(tmp_path / "archive"))
    assert {r.kind for r in artifacts.column_metas(encoded).collect()} & {"delta", "integer", "fixed"}
    artifacts.write_templates(found, str(tmp_path / "t"))
    again = artifacts.read_templates(spark, str(tmp_path / "t"))
    assert sorted((r.eid, r.text, r.tokens) for r in again.collect()) == sorted((r.eid, r.text, r.tokens) for r in found.collect())
    layout = engine.layout(log)
    artifacts.write_layout(layout, str(tmp_path / "layout"))
    assert sorted(map(tuple, artifacts.read_layout(spark, str(tmp_path / "layout")).collect())) == sorted(map(tuple, layout.collect()))


def test_sources_keep_apart(spark, tmp_path):
    texts = {f"{name}.log": [f"2024-01-0{k} app: {name} took {i * k} ms" for i in range(60 * k)] + ["", f"odd {name}"] for k, name in enumerate("abc", 1)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    engine = LogEngine(spark, EngineConfig(head_length=1, kernel="gzip"))
    log = engine.read(str(tmp_path / "*.log")).cache()
    facts = engine.evaluate(log, str(tmp_path / "archive"))
    assert facts["score"] == 1.0
    back = engine.restore(str(tmp_path / "archive")).orderBy("src", "rec_no").collect()
    assert {name: [r.line for r in back if r.src.endswith(name)] for name in texts} == texts
    encoded, _, _ = artifacts.read_archive(spark, str(tmp_path / "archive"))
    assert encoded.filter("scope = 'E'").groupBy("src", "block_id").count().filter("count = 1").count() == 3


def test_headers_that_do_not_fit_the_layout_are_kept_raw(spark, tmp_path):
    lines = [f"2024-01-{i % 28 + 1:02d} host{i}: job {i} done" for i in range(200)] + ["2024/01/02 host1: job 5 done", "2024-1-2 host1: job 5 done", "x2024-01-02 host1: job 5 done"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    for check, raw in ((False, 0), (True, 3)):
        engine = LogEngine(spark, EngineConfig(head_length=1, kernel="none", check_header=check))
        log = engine.read(str(tmp_path / "a.log")).cache()
        engine.compress(log, engine.train(log), str(tmp_path / f"archive{raw}"))
        _, failed, _ = artifacts.read_archive(spark, str(tmp_path / f"archive{raw}"))
        assert sorted(r.raw for r in failed.collect()) == sorted(lines[200:] if check else [])
        assert [r.line for r in engine.restore(str(tmp_path / f"archive{raw}")).orderBy("rec_no").collect()] == lines


def test_multi_line_engine(spark, tmp_path):
    text = "[1] a b\n  more\n[2] a c\n[3] a d\n tail"
    (tmp_path / "m.log").write_text(text)
    log = LogEngine(spark, EngineConfig(head_regex=r"\[")).read(str(tmp_path / "m.log"))
    assert [r.line for r in log.orderBy("rec_no").collect()] == ["[1] a b\n  more", "[2] a c", "[3] a d\n tail"]


def test_template_text():
    rows = [(1, "a <*>"), (2, "two\nlines"), (7, "x=1")]
    assert artifacts.parse_templates(artifacts.template_text(rows)) == rows
    assert artifacts.tokens_of("a=<*>,b") == ["a", "=", "<*>", ",", "b"]


def test_packed_files(spark, tmp_path):
    (tmp_path / "a.bz2").write_bytes(bz2.compress(b"hello"))
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("in.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    out = {r.member: bytes(r.content) for r in artifacts.read_packed(spark, str(tmp_path)).collect()}
    assert out == {"": b"hello", "in.txt": b"abc"}
