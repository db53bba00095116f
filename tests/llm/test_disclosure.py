from oddsloom.llm import privacy as pv
from tests.llm.data import frame, prose


def test_disclosing_words_are_marked_wherever_they_stand(spark):
    mail = "bob.x@mail.example.com"
    far = [f"{mail} {prose(i, 80)} zyzzyva {prose(50 + i, 70)} zyzzyva" for i in range(30)]
    texts = [*far, f"no address here but zyzzyva {prose(99, 10)}", *(prose(200 + i, 60) for i in range(60))]
    rows = [(i, t, "xx", "s") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in pv.find_private(frame(spark, rows)).collect()}
    marked = lambda i: [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].spans.split(",") if s) if k in pv.ADDED]
    # 80 and 151 words from the address, and in a text without it (30 of 31 documents with the word have the address).
    assert all(marked(i).count("zyzzyva") == 2 for i in range(30)) and marked(30) == ["zyzzyva"]
    clean = {r.doc_id: r.text for r in pv.sanitise(frame(spark, rows)).collect()}
    assert not any("zyzzyva" in clean[i] for i in range(31))
