"""Page extraction, the Merkle manifest and conversation repair against plain versions, on odd rows and on empty tables."""

import random
import re
from hashlib import sha256
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from mirrorloom.llm import conversation_repair as R
from mirrorloom.llm import html_blocks as H
from mirrorloom.llm import merkle_manifest as M
from mirrorloom.llm import queries

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Text of the one article of a generated page, with a space at every tag but inline ones."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag != "b":
            self.parts.append(" " if self.inside else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag != "b":
            self.parts.append(" " if self.inside else "")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_pages_equal_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Article()
        plain.feed(pages[r.page_id].html)
        want = re.sub(r"\s+", " ", "".join(plain.parts)).strip()
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


LONG = "It was the best of the days and the worst of the days for all of us who had to be there at the time."
ROUND = [
    (f"<header>Site of the day</header><nav><a href=/>Home</a></nav><main><article><h1>Title</h1><p>{LONG}<p>Short &eacute;&#33;<aside>More in the sidebar {LONG}</aside>"
     f"<form>Your name <input><textarea>x</textarea></form><p>End <a href=x>of</a> it.</article><section id='comments'><p>{LONG}</p></section></main><footer>(c)</footer>", f"Title {LONG} Short é! End of it."),
    (f"<div class='cookie-notice'>{LONG}</div><div id=content><h2>Head</h2><p>{LONG}</p><p>Tail.</p></div><div class=\"sidebar\"><p>{LONG}</p></div><div class='ad-box'>{LONG}</div>", f"Head {LONG} Tail."),
    (f"<p>{LONG}</p><p>Yes.</p><ul><li><a href=a>One link</a></li><li><a href=b>Another link</a></li></ul><p>Next to links.</p>", f"{LONG} Yes."),
    ("<article><p>Only <i>short</i>\n one</p><p>a</p></article><p>outside</p>", "Only short one a"),
    (f"<article><p>{LONG} <span class='ad'>buy the thing</span> done</p><article class='comment'>{LONG}</article></article>", f"{LONG} done"),
    (f"<nav><ul><li><a href=x>unclosed<article><p>{LONG}</p></article>", LONG),
    ("<script>var x = '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>a < b &amp;lt; <b>c</b>d<br>e", "a < b &lt; cd e"),
    ("<p title='a > b' data-x=\"it's\">kept</p><p unclosed", "kept"),
    (None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<", "<"), ("</p></div>", ""),
]


def test_planted_pages(spark):
    pages = spark.createDataFrame([(i, "u", h, "t", 1) for i, (h, _) in enumerate(ROUND)] + [(None, None, "<p>x", None, None)] * 2, "page_id long, url string, html string, text string, n_chars long")
    got = H.extract(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None} == {i: t for i, (_, t) in enumerate(ROUND)}
    assert [(r.text, r.n_chars) for r in got if r.page_id is None] == [("x", 1)] * 2
    assert H.extract(pages.limit(0)).count() == 0
    assert len(H.main_text(f"<article>{'<p>word <a>'* 50_000}")) == 250_000 - 1


def test_second_pass_is_nearest_decided():
    rng = random.Random(5)
    for _ in range(300):
        page = [H.Block("x", 0, rng.choice([0, 1, 1, 2]), "p", rng.random() < 0.1) for _ in range(rng.randint(0, 14))]
        labels = [H.BAD if b.outside else rng.choice([H.GOOD, H.BAD, H.OPEN, H.OPEN]) for b in page]
        marked = any(b.article for b in page if not b.outside)
        want = []
        for i, b in enumerate(page):
            same = [k for k, c in enumerate(page) if c.article == b.article and not c.outside]
            decided = [(abs(same.index(k) - same.index(i)), -labels[k]) for k in same if labels[k] != H.OPEN] if labels[i] == H.OPEN else []
            want.append(labels[i] if labels[i] != H.OPEN else -min(decided)[1] if decided else H.GOOD if b.article or not marked else H.BAD)
        assert H.second_pass(page, labels) == want


def plain_tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """Root and proofs by levels, as hex text."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            run = at[i] // 3 * 3
            p += [x for k, x in enumerate(nodes[run : run + 3], run) if k != at[i]]
            at[i] //= 3
        nodes = [sha256("".join(nodes[k : k + 3]).encode()).hexdigest() for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_leaf(row) -> str:
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_levels(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "ä"]), "en", 3, f"t{i}\nx") for i in range(60)] + [(99, "single", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    trees: dict = {}
    for r in sorted(rows):
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = {s: plain_tree([plain_leaf(r) for r in trees[s]]) for s in order}
    root, tops = plain_tree([subroots[s][0] for s in order])
    want = {r[0]: (plain_leaf(r), subroots[s][0], root, sha256("".join(subroots[s][1][k] + tops[order.index(s)]).encode()).hexdigest(), True) for s in order for k, r in enumerate(trees[s])}
    got = M.manifest(docs, height=height).collect()
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got} == want
    changed = M.manifest(docs, claimed=M.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", "\n", "")]), height=height).collect()
    assert {r.doc_id for r in changed if r.verified} == {99} and all(r.root == root for r in changed)


def test_manifest_on_odd_and_empty_tables(spark, odd, none):
    got = M.manifest(odd).collect()
    assert len(got) == odd.count() and len({r.root for r in got}) == 1 and all(r.verified and r.folded_root == r.root for r in got)
    assert M.manifest(none).count() == 0
    one = M.manifest(odd.where("doc_id = 9")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha256().hexdigest() and one.proof == b""


def all_repairs(initials: str, faults: bytes) -> tuple[int, str]:
    """Cheapest (cost, audit) by levels of cost: every string of edits with up to two insertions in a row is tried."""
    best = {(0, R.START): (0, "")}
    for i in range(len(faults) + 1):
        for _ in range(3):
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    to = (i, R.MOVES[state, R.GIVEN[state][0]])
                    best[to] = min(best.get(to, (99999, "")), (cost + 2, audit + "I"))
        if i == len(faults):
            break
        for state in range(4):
            if (i, state) not in best:
                continue
            cost, audit = best[i, state]
            ways = [((i + 1, state), 3, "D")]
            if faults[i] not in (R.BLANK, R.DUPLICATE):
                late = int(faults[i] == R.TRUNCATED)
                ways.append(((i + 1, R.MOVES[state, R.GIVEN[state][0]]), 2 + late, "R"))
                if (state, initials[i]) in R.MOVES:
                    ways.append(((i + 1, R.MOVES[state, initials[i]]), late, "K"))
            for to, more, edit in ways:
                best[to] = min(best.get(to, (99999, "")), (cost + more, audit + edit))
    return min(best[len(faults), s] for s in R.ACCEPTING if (len(faults), s) in best)


def test_search_is_cheapest_and_least():
    rng = random.Random(13)
    for _ in range(2000):
        n = rng.randint(0, 9)
        initials, faults = "".join(rng.choice("suaax ") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert R.repair(initials, faults) == all_repairs(initials, faults)


def test_long_conversations_equal_short_ones(spark):
    rng = random.Random(2)
    rows = [(c if c else None, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", None, "", "x"]), rng.choice(["Yes.", "No!", "", None, "well", "So it is. \n"])) for c in range(5) for _ in range(rng.choice([4, 50]))]
    said = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    key = lambda r: (r.id is not None, r.id)
    whole, cut = (sorted(R.repair_conversations(said, n).collect(), key=key) for n in (1000, 7))
    assert whole == cut and len(whole) == 5 and whole[0].id is None
    assert all(re.fullmatch(r"[KRDI]*", r.audit) for r in whole)


def test_conversations_on_odd_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, key string, id string"
    # crc32("1:6") and crc32("1:22") are multiples of twenty: both rows are dropped
    gone = [t for t in range(400) if __import__("zlib").crc32(f"1:{t}".encode()) % 20 == 0][:2]
    rows = [(1, t, "user", "Hi.", "k", "x") for t in gone] + [(2, None, None, None, None, None), (None, None, "user", "word " * 50_000, "k", "x")]
    got = {r.id: r for r in R.repair_conversations(R.damaged(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 2, None}
    assert (got[1].gaps, got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, 0, "", sha256().hexdigest())
    assert got[2].gaps == 0 and got[2].blank + got[2].duplicate >= 1 and set(got[2].audit) <= {"D"}
    assert R.repair_conversations(R.damaged(spark.createDataFrame([], schema))).count() == 0
