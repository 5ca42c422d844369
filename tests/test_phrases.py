import pytest

from proselens.operators import config, phrases, report

DASH = "—"
CASES = [
    ("They call the new oven a game-changer.", "banned-phrase", True), ("Every paradigm shifts with its users.", "banned-phrase", False), ("Call it a paradigm shift, if you must.", "banned-phrase", True),
    ("Here's the thing: rents fell.", "engagement-bait", True), ("Here’s the thing: rents fell.", "engagement-bait", True), ("In conclusion, buy the smaller boat.", "banned-phrase", True),
    ("We saw a significant drop in rainfall.", "filler", True), ("Its signification was lost on us.", "filler", False), ("Their load-bearing excuse gave way.", "load-bearing-context", True),
    ("What she left out is load-bearing.", "load-bearing-context", True), ("Check the load-bearing member first.", "load-bearing-context", False), ("Cut no load-bearing\nbeam before March.", "load-bearing-context", False),
    ("One payload-bearing rocket left.", "load-bearing-context", True), (f"The ferry left {DASH} we waved.", "dash", True), ("Take 9 − 4 apples.", "dash", False),
    ("He closed the ledger quietly.", "loaded-adverb", False), ("quietly they rowed, quietly they sang, quietly they slept", "overuse", True), ("quietly they rowed and quietly they sang", "overuse", False),
    ("More at https://news.msn.com/a/1 today.", "source", False), ("Never type `game-changer` here.", "banned-phrase", False), ("x\n```\ngame-changer\n```\ny", "banned-phrase", False),
    ("x\n```\ngame-changer\nnever closed", "banned-phrase", True), ("cafégame-changer", "banned-phrase", False), ("game-changeŕ", "banned-phrase", False),
    ("one game-changer café", "banned-phrase", True), ("Nobody's\ntalking about rain", "engagement-bait", False), ("it's worth kingfishers", "soft-cliche", True), ("the honest truth", "soft-cliche", True),
    ("game-changer_x", "banned-phrase", True), ("robust_x", "filler", False), ("", "banned-phrase", False), (None, "banned-phrase", False),
]


def run(spark, texts, cfg=None):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = phrases.checked(d, cfg or config.resolve()).select("doc_id", "findings", "suppressed").collect()
    return {r["doc_id"]: ([(f["line"], f["col"], f["rule"], f["match"]) for f in r["findings"]], r["suppressed"]) for r in rows}


def test_cases(spark):
    got = run(spark, [t for t, _, _ in CASES])
    wrong = [c for k, c in enumerate(CASES) if any(f[2] == c[1] for f in got[k][0]) != c[2]]
    assert not wrong


def test_positions_order_and_shadowing(spark):
    got = run(spark, ["a bc\nsome game-changer, yes", "it's worth noting that it's worth sailing", "\U0001d54f\U0001d54f game-changer", "worth its weight in gold"])
    assert got[0][0] == [(2, 6, "banned-phrase", "game-changer")]
    assert [f[2] for f in got[1][0]] == ["banned-phrase", "soft-cliche"]
    assert got[2][0][0][:2] == (1, 4)
    assert [f[3] for f in got[3][0]] == ["worth its weight", "worth its weight in gold"]


def test_dash_density(spark):
    cfg = config.resolve({"no_dashes": False})
    text = lambda words, dashes: " ".join(["w"] * words) + f" {DASH}" * dashes
    got = run(spark, [text(149, 3), text(150, 3), text(150, 2), text(5, 2)], cfg)
    assert [len(got[k][0]) for k in range(4)] == [0, 1, 0, 0]
    assert got[1][0][0][1] == len(text(150, 0)) + 4  # the second dash, the first over the allowance of one


def test_loaded_adverb(spark):
    cfg = config.resolve({"flag_loaded_quietly": True})
    got = run(spark, ["The bakery moved quietly.", "A quietly amused judge nodded.", "It ended quietly\nand more"], cfg)
    assert [any(f[2] == "loaded-adverb" for f in got[k][0]) for k in range(3)] == [True, False, True]


@pytest.mark.parametrize(("url", "hit"), [("https://www.msn.com/story", 1), ("https://timesofindia.indiatimes.com/x", 1), ("https://example.com/path/msn.com/story", 0), ("https://example.com/?u=https://msn.com/x", 0),
                                          ("https://www.congress.gov/bill", 0), ("https://www.msn.com./story", 1), ("https://msn.com@evil.example/x", 0), ("HTTPS://u:p@MSN.com:8080/x", 1), ("http://[x", 0)])
def test_sources(spark, url, hit):
    cfg = config.resolve({"aggregator_domains": ["msn.com", "timesofindia"]})
    assert sum(f[2] == "source" for f in run(spark, [f"See {url} now"], cfg)[0][0]) == hit


def test_suppression(spark):
    t = "This is a game-changer."
    texts = [f"{t} <!-- proselint: ignore-line banned-phrase -->", f"<!-- proselint: ignore-next-line -->\n{t}", f"{t} <!-- proselint: ignore-line filler -->", f"`<!-- proselint: ignore-line -->` {t}",
             f"proselint: ignore-line {t}", f"{t} <!-- PROSELINT: IGNORE -->", f"<!-- proselint: IGNORE-NEXT-LINE -->\n{t}", f"{t} <!-- structproselint: ignore-line -->"]
    got = run(spark, texts)
    assert [(len(got[k][0]), got[k][1]) for k in range(len(texts))] == [(0, 1), (0, 1), (1, 0), (1, 0), (1, 0), (0, 1), (1, 0), (1, 0)]


def test_report(spark):
    d = spark.createDataFrame([(1, "A game-changer. Robust."), (2, "Clean."), (3, "Robust.")], "doc_id long, text string")
    total = report.totals(report.by_document(phrases.checked(d, config.resolve())))
    assert total.first().asDict() == {"documents": 3, "errors": 1, "warnings": 2, "suppressed": 0}
    assert report.exit_status(total).first()[0] == 1
    clean = report.totals(report.by_document(phrases.checked(d.where("doc_id = 3"), config.resolve())))
    assert (report.exit_status(clean).first()[0], report.exit_status(clean, strict=True).first()[0]) == (0, 1)
    none = report.totals(report.by_document(phrases.checked(d.where("doc_id > 3"), config.resolve())))
    assert report.exit_status(none).first()[0] == 0
    rows = {r["doc_id"]: r["findings"] for r in report.json_report(phrases.checked(d, config.resolve()), "doc_id").collect()}
    assert rows[2] == "[]" and '"rule":"filler"' in rows[3]
