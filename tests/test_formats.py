import json

import numpy as np
import pytest

from provq.sinks import formats as out
from provq.sources import formats as src


def test_feature_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    d, p = rng.normal(size=(3, 8)).astype("f4"), rng.normal(size=(3, 4)).astype("f4")
    (tmp_path / "a.bin").write_bytes(out.feature_file(d, p, 640, 480))
    (tmp_path / "cut.bin").write_bytes(out.feature_file(d, p, 640, 480)[:-20])
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = src.feature_files(spark, [str(tmp_path)], 8).orderBy("feature_no").collect()
    assert len(rows) == 3 and all(r["path"].endswith("a.bin") and (r["width"], r["height"]) == (640, 480) for r in rows)
    assert np.array_equal(np.array([r["descriptor"] for r in rows], "f4"), d) and np.allclose([[r["x"], r["y"], r["size"], r["angle"]] for r in rows], p)


@pytest.mark.parametrize("kind", "fib")
def test_vector_files(spark, tmp_path, kind):
    x = np.arange(24).reshape(4, 6)
    (tmp_path / f"v.{kind}vecs").write_bytes(out.vector_file(x, kind) + b"\x06\x00")
    assert [r["vector"] for r in src.vector_files(spark, [str(tmp_path)], kind).orderBy("row_no").collect()] == x.tolist()


def test_containers(spark, tmp_path):
    parts = [b"index", b"", b"x" * 1000]
    (tmp_path / "c").write_bytes(out.container(parts))
    assert [bytes(r["content"]) for r in src.containers(spark, [str(tmp_path)]).orderBy("member_no").collect()] == parts
    with pytest.raises(ValueError):
        src.members(out.container(parts)[:-1])


def test_lists_and_probes(spark, tmp_path):
    for p in ("x/b.one.jpg", "y/b.two.jpg", "y/c.PNG", "y/d.txt"):
        (tmp_path / "w" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / p).write_text("x")
    got = {r["stem"]: r["path"] for r in src.source_list(spark, [str(tmp_path / "w")]).collect()}
    assert set(got) == {"b", "c", "d"} and got["b"].endswith("x/b.one.jpg")
    assert src.image_list(spark, [str(tmp_path / "w")]).count() == 3
    (tmp_path / "plain.txt").write_text("p/one.jpg\n\np/two.jpg\n")
    assert {r["probe_id"] for r in src.probes(spark, str(tmp_path / "plain.txt")).collect()} == {"one", "two"}
    (tmp_path / "t.csv").write_text("TaskID|ProvenanceProbeFileID|ProvenanceProbeFileName\nt|id1|probe/a.jpg\n")
    assert [tuple(r) for r in src.probes(spark, str(tmp_path / "t.csv")).collect()] == [("id1", "probe/a.jpg")]
    (tmp_path / "w.csv").write_text("TaskID|WorldFileID|WorldFileName\nt|i|world/z.jpg\n")
    assert [r["file"] for r in src.world_index(spark, str(tmp_path / "w.csv"), "/data/").collect()] == ["/data/world/z.jpg"]
    (tmp_path / "r.txt").write_text("p,a,b\n")
    assert [tuple(r) for r in src.rank_file(spark, str(tmp_path / "r.txt")).collect()] == [("p", 1, "a"), ("p", 2, "b")]
    (tmp_path / "m.json").write_text(json.dumps({"_rootDirectory_": "/r", "a": "/r/a.jpg"}))
    assert [tuple(r) for r in src.path_map(spark, str(tmp_path / "m.json")).collect()] == [("a", "/r/a.jpg")]
    (tmp_path / "l.csv").write_text('"id","url","landmark_id"\n"1","u","5"\n"2","u","None"\n')
    assert [r["id"] for r in src.landmarks(spark, str(tmp_path / "l.csv")).collect()] == ["1"]


def test_documents(spark, tmp_path):
    from provq.operators import results

    top = spark.createDataFrame([("p1", 1, "world/a.jpg", "a", 0.5), ("p1", 2, "world/b.jpg", "b", 0.25)], "g string, rank int, file string, fileid string, score double")
    docs = results.documents(top, "g", "file", "fileid")
    assert json.loads(docs.collect()[0]["document"]) == {"directed": True, "nodes": [{"id": "1", "file": "world/a.jpg", "fileid": "a", "nodeConfidenceScore": 0.5}, {"id": "2", "file": "world/b.jpg", "fileid": "b", "nodeConfidenceScore": 0.25}], "links": []}
    assert out.result_folder(docs, "g", str(tmp_path / "json")).count() == 1
    assert {r["fileid"] for r in src.result_documents(spark, [str(tmp_path / "json")]).filter("probe_id = 'p1'").collect()} == {"a", "b"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "one.json").write_text(json.dumps({"nodes": [{"file": "a", "id": "x"}, {"file": "b", "id": "y"}], "links": [{"source": 0, "target": 1, "op": "Donor"}]}))
    nodes, links = src.journals(spark, [str(tmp_path / "j")])
    assert [tuple(r) for r in nodes.orderBy("idx").collect()] == [("one", 0, "a", "x"), ("one", 1, "b", "y")] and links.collect()[0]["op"] == "Donor"
    out.manifest(spark.createDataFrame([("p1", 0.5, "p1.json"), ("p2", None, None)], "probe_id string, score double, output string"), str(tmp_path / "m"))
    assert {r["ProvenanceProbeStatus"] for r in src.piped(spark, str(tmp_path / "m")).collect()} == {"Processed", "NonProcessed"}
    c = out.cluster_documents(spark.createDataFrame([(1, "a"), (1, "b")], "cluster bigint, member string"), "markov").collect()[0]
    assert c["name"] == "cluster001_size2_algorithm_markov.json"
    g = out.graph_documents(spark.createDataFrame([(1, 0, "a", "a")], "probe_id bigint, idx int, file string, fileid string"), spark.createDataFrame([], "probe_id bigint, source int, target int, score double")).collect()[0]
    assert json.loads(g["document"])["nodes"][0]["id"] == "0"
