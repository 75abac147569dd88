import json
import sys

from marginalia.cli import ask, evaluate, main
from marginalia.config import IndexConfig
from marginalia.sources.labelled import write_report
from marginalia.sources.store import Store

MODULE = """
import json

def pages(data):
    if b"FAIL" in data:
        raise ValueError("no text")
    return [(n, t) for n, t in enumerate(data.decode().removeprefix("%PDF").split("\\f"), 1)]

def reply(system, user):
    if user.startswith("{"):
        return json.dumps({"verdicts": [{"claim_id": c["claim_id"], "supported": True, "reason": "r"} for c in json.loads(user)["claims"]]})
    return json.dumps({"status": "answered", "answer": "Rivers flood in spring [E1]."})
"""


def test_library_to_answer(spark, tmp_path, monkeypatch, capsys):
    library = tmp_path / "library"
    library.mkdir()
    (library / "rivers.pdf").write_bytes(b"%PDF# A study of river floods\n\nRivers flood in spring because snow melts.\fA study of river floods 2\nDams hold water back.")
    (library / "lakes.pdf").write_bytes(b"%PDFLakes and what lives in them\n\nLakes freeze in winter.")
    (library / "blank.pdf").write_bytes(b"%PDF \f ")
    (tmp_path / "models_of_test.py").write_text(MODULE)
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}:{__import__('os').environ['PYTHONPATH']}")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "models_of_test.py"))
    where = str(tmp_path / "store")
    assert main(["sync", str(library), "--store", where, "--converter", "models_of_test:pages"]) == 0
    store = Store(spark, where, IndexConfig())
    assert {(tuple(r.paths), r.status) for r in store.manifest().collect()} == {(("rivers.pdf",), "indexed"), (("lakes.pdf",), "indexed"), (("blank.pdf",), "empty")}
    chunks = store.visible_chunks().where("source = 'rivers.pdf'").orderBy("page", "chunk_index").collect()
    assert chunks[0].title == "A study of river floods" and chunks[-1].text == "Dams hold water back." and chunks[0].id.endswith("-1-0")
    answer = ask(spark, store, "When do rivers flood?", sys.modules.get("models_of_test", __import__("models_of_test")).reply, "rivers.pdf")
    assert answer.status == "answered" and answer.evidence[0].source == "rivers.pdf"
    assert main(["ask", "When do rivers flood?", "--store", where, "--backend", "models_of_test:reply"]) == 0 and "[E1]" in capsys.readouterr().out
    write_report(tmp_path / "g.json", {"version": 1, "name": "n", "cases": [{"id": "1", "question": "When do rivers flood?", "expected": "answered", "evidence": [{"source": "rivers.pdf", "page": 1}]}, {"id": "2", "question": "zzz", "expected": "abstained"}]})
    report = evaluate(spark, store, str(tmp_path / "g.json"))
    assert (report["retrieval_cases"], report["recall"], report["locators"]["locator_recall"]) == (1, 1.0, 1.0)
    assert main(["evaluate", str(tmp_path / "g.json"), "--store", where, "--report", str(tmp_path / "r.json")]) == 0 and json.loads((tmp_path / "r.json").read_text())["recall"] == 1.0
