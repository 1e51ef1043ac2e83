"""Detections that follow changing pages equal those of judging all pages anew."""

import random

import pytest

from harrow.operators import incremental, page_rules
from harrow.plans import page_queries as P
from harrow.sources import html

PAGES = "page_id long, url string, html string"
BITS = ["<p>plain words</p>", "<span>Only 2 left</span>", "<b>Ends in 02:05</b>", '<div class="comments">c</div>', "<footer>f</footer>", "<article>x<footer>g</footer></article>", f"<p>{P.BAD}</p>", '<div class="ad"><div class="ads">z</div></div>', "<button>No thanks, I hate saving</button>", '<form><input name=a value=b><input type=checkbox checked name=extra></form>']
RULES = [r for r in page_rules.RULES if r.rule_id in ("countdown-timer-redact", "scarcity-redact", "confirmshame-sanitize", "footer-redact", "comments-redact", "ads-hide", "checkout-checkbox-sanitize", "prompt-injection-redact", "form-prefill-annotate")]


def full(spark, pages):
    nodes = html.nodes(spark.createDataFrame([(i, u, h) for i, (u, h) in pages.items()], PAGES), url="url")
    return sorted((r.page_id, r.rule_id, r.node_id, r.evidence) for r in page_rules.detect(nodes, RULES).collect())


def now(spark, path):
    return sorted((r.page_id, r.rule_id, r.node_id, r.evidence) for r in incremental.detections(spark, path).collect())


@pytest.fixture(scope="module")
def edits():
    """Versions of a few pages: pieces are put in, taken out, moved and changed."""
    rng = random.Random(21)
    bodies = {i: [rng.choice(BITS) for _ in range(rng.randint(0, 12))] for i in range(12)}
    out = [{i: rng.choice(["https://shop.example.com/checkout", "https://a.example.org/"]) for i in bodies}]
    urls = out.pop()
    page = lambda i: (urls[i], f"<html><body><div id=m>{''.join(bodies[i])}</div></body></html>")
    out.append({i: page(i) for i in bodies})
    for _ in range(2):
        some = rng.sample(sorted(bodies), 4)
        for i in some:
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(bodies[i]))
                kind = rng.randrange(3)
                if kind == 0 or not bodies[i]:
                    bodies[i].insert(at, rng.choice(BITS))
                elif kind == 1:
                    del bodies[i][at - 1]
                else:
                    bodies[i].insert(at - 1, bodies[i].pop(rng.randrange(len(bodies[i]))))
        out.append({i: page(i) for i in some} | {0: page(0)})
    return out


def test_updates_equal_the_full_run(spark, tmp_path, edits):
    path, state = str(tmp_path / "state"), {}
    for k, change in enumerate(edits):
        done = incremental.update(spark.createDataFrame([(i, u, h) for i, (u, h) in change.items()], PAGES), path, RULES)
        before, state = dict(state), state | change
        assert now(spark, path) == full(spark, state)
        assert done["pages"] == len(change) and done["changed"] == sum(before.get(i) != v for i, v in change.items())
        if k:
            total = html.nodes(spark.createDataFrame([(i, u, h) for i, (u, h) in change.items()], PAGES), url="url").count()
            assert done["judged"] < total / 2
    # The same again changes nothing; a page without html goes.
    assert incremental.update(spark.createDataFrame([(i, u, h) for i, (u, h) in edits[-1].items()], PAGES), path, RULES)["changed"] == 0
    gone = max(edits[-1])
    incremental.update(spark.createDataFrame([(gone, "u", None)], PAGES), path, RULES)
    assert now(spark, path) == full(spark, {i: v for i, v in state.items() if i != gone})
    assert incremental.update(spark.createDataFrame([], PAGES), path, RULES) == {"pages": 0, "changed": 0, "judged": 0}


def test_follow_a_stream(spark, tmp_path):
    versions, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = PAGES + ", version long"
    url = "https://shop.example.com/checkout"
    for batch in ([(1, url, BITS[1], 1), (2, url, BITS[0], 1)], [(1, url, BITS[0] + BITS[1], 3), (1, url, BITS[2], 2), (3, url, BITS[4], 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(versions)
        stream = spark.readStream.schema(schema).parquet(versions)
        query = incremental.follow(stream, state, str(tmp_path / "c"), RULES)
        query.processAllAvailable()
        query.stop()
    assert now(spark, state) == full(spark, {1: (url, BITS[0] + BITS[1]), 2: (url, BITS[0]), 3: (url, BITS[4])})
