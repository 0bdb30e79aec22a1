from gradeloom.llm import scans

PAGE = """The harbour was quiet before the b0at crossed the
river. Most of the sailors had never seen the self-
taught captain, and the old harbour was a sur-
     The Harbour Reader
     12
prise to them. Nobody knew about the harbour of
the town before the captain boarded the vessel."""
CLEAN = "The boat crossed the river. A boat is a self-taught captain's surprise. The b12 tin."


def _contexts(spark):
    rows = [(1, PAGE), (1, PAGE), (2, CLEAN), (3, None), (4, "  ")]
    return spark.createDataFrame(rows, "context_id bigint, context string")


def test_find(spark):
    got = sorted(map(tuple, scans.find(_contexts(spark)).collect()))
    assert got == [(1, "header", "The Harbour Reader"), (1, "hyphen", "self-taught"), (1, "hyphen", "surprise"), (1, "ocr", "boat"), (1, "pageno", "12")]


def test_repaired(spark):
    got = dict(map(tuple, scans.repaired(_contexts(spark)).collect()))
    assert got[1] == " ".join(PAGE.replace("     The Harbour Reader\n     12\n", "").replace("b0at", "boat").replace("self-\n", "self-").replace("sur-\n", "sur").split())
    assert got[2] == CLEAN and got[3] is None and set(got) == {1, 2, 3, 4}


def test_a_sentence_beside_a_page_number_is_no_heading():
    text = "The culture relieved the patient before the blood test.\n125.\nIf the diagnosis had not monitored the old anaesthetic\nbefore the test, the quarantine would still be chronic.\nEven the surgeon was unusual in the hospital of the\ntown, and the patient was anaemic."
    assert "If the diagnosis" in scans.repair(text, {}, {})


def test_confusions_in_place():
    assert scans.replaced("tliese", "these") == (0, 1, 0)
    assert scans.replaced("trave11er", "traveller") == (2, 0, 0)
    assert scans.replaced("boat", "coat") is None
    assert scans.anagram("these") in scans.targets("tliese")
