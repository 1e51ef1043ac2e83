"""Node algebra, selectors, style sheets and site patterns against naive walks on random trees."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import dom, selectors

NODE = "page_id long, node_id int, parent_id int, pre int, end int, depth int, kind string, tag string, attrs map<string,string>, text string"


def random_tree(rng, page, n, tags="abp", classes="xyz"):
    """Nodes of a random page in document order; some have an id, classes and another attribute."""
    nodes, stack = [], []
    for pre in range(n):
        while stack and rng.random() < 0.45:
            stack.pop()
        attrs = {}
        if rng.random() < 0.6:
            attrs["class"] = " ".join(rng.sample(classes, rng.randint(1, 2)))
        if rng.random() < 0.2:
            attrs["id"] = rng.choice("mn")
        if rng.random() < 0.3:
            attrs["data-k"] = rng.choice(["one", "one two", "Two", "en-GB", ""])
        nodes.append({"page_id": page, "node_id": pre, "parent_id": stack[-1] if stack else None, "pre": pre, "end": pre, "depth": len(stack), "kind": "element", "tag": rng.choice(tags), "attrs": attrs, "text": None})
        for up in stack:
            nodes[up]["end"] = pre
        stack.append(pre)
    return nodes


def frame(spark, nodes):
    names = [f.split()[0] for f in NODE.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODE)


def ancestors(tree, n, own=False):
    """Up from a node, the nearest first."""
    at = n["node_id"] if own else n["parent_id"]
    while at is not None:
        yield tree[at]
        at = tree[at]["parent_id"]


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(11)
    return {page: random_tree(rng, page, rng.randint(1, 40)) for page in range(60)}


def test_nearest_inside_and_climb(spark, trees):
    rng = random.Random(12)
    flat = [n for t in trees.values() for n in t]
    mark = {(n["page_id"], n["node_id"]): (rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.2) for n in flat}
    is_ = lambda n, k: mark[n["page_id"], n["node_id"]][k]
    found, holders, barriers = (frame(spark, [n for n in flat if is_(n, k)]) for k in range(3))
    want = {}
    for n in flat:
        if is_(n, 0):
            tree = trees[n["page_id"]]
            up = list(ancestors(tree, n, True))
            near = next((a["node_id"] for a in up if is_(a, 1)), None)
            strict = next((a["node_id"] for a in up[1:] if is_(a, 1)), None)
            reached = None
            for hops, a in enumerate(up[:4]):
                if hops and is_(a, 2):
                    break
                if is_(a, 1):
                    reached = a["node_id"]
                    break
            want[n["page_id"], n["node_id"]] = (near, strict, reached)
    key = lambda r: (r.page_id, r.node_id)
    assert {key(r): r.holder_id for r in dom.closest(found, holders).collect()} == {k: v[0] for k, v in want.items()}
    assert {key(r): r.up for r in dom.nearest(found, holders, "up", F.col("node_id"), strict=True).collect()} == {k: v[1] for k, v in want.items()}
    assert {key(r): r.holder_id for r in dom.climb(found, holders, barriers, 3).collect()} == {k: v[2] for k, v in want.items()}
    assert {key(r) for r in dom.inside(found, holders).collect()} == {k for k, v in want.items() if v[1] is not None}
    assert {key(r) for r in dom.inside(found, holders, "left_anti").collect()} == {k for k, v in want.items() if v[1] is None}
    assert dom.closest(found, holders.limit(0)).filter("holder_id IS NOT NULL").count() == 0


def naive_simple(n, c):
    attrs = n["attrs"]

    def attribute(a):
        v, x = attrs.get(a["name"]), a["value"]
        if v is None:
            return False
        v = v.lower() if a["fold"] else v
        return {"": lambda: True, "=": lambda: v == x, "^=": lambda: x != "" and v.startswith(x), "$=": lambda: x != "" and v.endswith(x), "*=": lambda: x != "" and x in v, "~=": lambda: x in v.split(), "|=": lambda: v == x or v.startswith(x + "-")}[a["op"]]()

    return c["tag"] in (None, n["tag"]) and all(attrs.get("id") == i for i in c["ids"]) and all(k in attrs.get("class", "").split() for k in c["classes"]) and all(map(attribute, c["attrs"]))


def naive_match(tree, n, steps):
    """From the last step upwards, with all choices."""
    step = steps[-1]
    if not naive_simple(n, step) or any(naive_simple(n, x) for x in step["nots"]):
        return False
    if len(steps) == 1:
        return True
    siblings = [m for m in tree if m["parent_id"] == n["parent_id"] and m["pre"] < n["pre"]]
    choices = {" ": list(ancestors(tree, n)), ">": list(ancestors(tree, n))[:1], "~": siblings, "+": siblings[-1:]}[step["link"]]
    return any(naive_match(tree, m, steps[:-1]) for m in choices)


def random_selector(rng):
    def simple(depth=0):
        parts = [rng.choice(["a", "b", "p", "*", ""])]
        parts += [rng.choice([".x", ".y", ".z", "#m", "#n", "[data-k]", '[data-k="one"]', "[data-k^=on]", "[data-k$='o']", "[data-k*=n]", "[data-k~=two]", "[data-k|=en]", "[data-k=two i]"]) for _ in range(rng.choice([0, 1, 1, 2]))]
        if not depth and rng.random() < 0.2:
            parts.append(f":not({simple(1)})")
        return "".join(parts) or "*"

    one = lambda: "".join(x for k in range(rng.randint(1, 4)) for x in ([rng.choice([" ", " > ", "+", " ~ "])] if k else []) + [simple()])
    return ", ".join(one() for _ in range(rng.choice([1, 1, 2])))


def test_selectors_equal_a_naive_walk(spark, trees):
    rng = random.Random(13)
    texts = sorted({random_selector(rng) for _ in range(250)})
    got = selectors.match(frame(spark, [n for t in trees.values() for n in t]), spark.createDataFrame([(t,) for t in texts], "selector string"))
    got = {(r.page_id, r.node_id, r.selector): list(r.specificity) for r in got.collect()}
    want = {}
    for text in texts:
        for a in selectors.parse(text):
            for tree in trees.values():
                for n in tree:
                    if naive_match(tree, n, a["steps"]):
                        key = (n["page_id"], n["node_id"], text)
                        want[key] = max(want.get(key, [0, 0, 0]), a["specificity"])
    assert got == want and len({k[2] for k in want}) > 150


def test_selectors_of_a_page(spark, trees):
    nodes = frame(spark, [n for t in trees.values() for n in t])
    texts = spark.createDataFrame([(1, ".x"), (2, ".x"), (2, "a > b, p .y"), (3, "a::before"), (999, "*")], "page_id long, selector string")
    got = {(r.page_id, r.node_id, r.selector) for r in selectors.match(nodes, texts, "page_id").collect()}
    want = {(n["page_id"], n["node_id"], s) for p, s in ((1, ".x"), (2, ".x"), (2, "a > b, p .y")) for a in selectors.parse(s) for n in trees[p] if naive_match(trees[p], n, a["steps"])}
    assert got == want and [r.selector for r in selectors.unread(texts).collect()] == ["a::before"]


def test_parse():
    steps = lambda s: [[(x["link"], x["tag"], x["ids"], x["classes"]) for x in a["steps"]] for a in selectors.parse(s)]
    assert steps(" A.b#c >d , .e ") == [[("", "a", ["c"], ["b"]), (">", "d", [], [])], [("", None, [], ["e"])]]
    assert selectors.parse("a:not(.b, #c) ~ :root[x='a,b']")[0]["specificity"] == [1, 2, 1]
    assert [selectors.parse(s) for s in ("", ",", "a:hover", "a::after", "a >", "> a", "a b:not(c d)", "[x", "a,,b")] == [None] * 9
    assert selectors.parse(r".a\:b")[0]["steps"][0]["classes"] == ["a:b"]


# Style sheets


def naive_cascade(tree, sheets, selector_steps):
    """Winners by definition: all declarations of all rules, the largest by (important, inline, specificity, place)."""
    out = {}
    for n in tree:
        for s, rules in enumerate(sheets):
            for r, (text, declarations) in enumerate(rules):
                fitting = [a["specificity"] for a in selector_steps[text] if naive_match(tree, n, a["steps"])]
                for k, (name, value, important) in enumerate(declarations if fitting else []):
                    rank = (important, False, max(fitting), s, r, k)
                    out[n["node_id"], name] = max(out.get((n["node_id"], name), ((),)), (rank, value))
        for k, (name, value, important) in enumerate(n["inline"]):
            out[n["node_id"], name] = max(out.get((n["node_id"], name), ((),)), ((important, True, [0] * 3, 0, 0, k), value))
    return {key: v[1] for key, v in out.items()}


def test_cascade_equals_its_definition(spark):
    from harrow.operators import cascade

    rng, nodes, want, inherited = random.Random(14), [], {}, {}
    say = lambda d: "".join(f"{n} : {v}{rng.choice([' !important', '!IMPORTANT']) if i else ''} ;" for n, v, i in d)
    some = lambda: [(rng.choice(["color", "visibility", "opacity", "left"]), rng.choice(["0", "1", "red", "hidden"]), rng.random() < 0.2) for _ in range(rng.randint(1, 3))]
    for page in range(32):
        tree = random_tree(rng, page, rng.randint(2, 25))
        for n in tree:
            n["inline"] = some() if rng.random() < 0.2 else []
            if n["inline"]:
                n["attrs"]["style"] = say(n["inline"])
        sheets = [[(random_selector(rng), some()) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(0, 3))]
        steps = {t: selectors.parse(t) for s in sheets for t, _ in s}
        won = naive_cascade(tree, sheets, steps)
        want |= {(page, *k): v for k, v in won.items()}
        for n in tree:
            for name in ("color", "visibility"):
                value = next((won[a["node_id"], name] for a in ancestors(tree, n, True) if (a["node_id"], name) in won), None)
                if value:
                    inherited[page, n["node_id"], name] = value
        at = len(tree)
        for s in sheets:
            css = "/* a{b:c} */" + "".join(f"{t} {{ {say(d)} }} " for t, d in s) + "@media print { * { left : 1 } } a:hover{left:1}"
            for kind, tag, text, parent in (("element", "style", None, None), ("text", None, css, at)):
                tree.append({"page_id": page, "node_id": len(tree), "parent_id": parent, "pre": len(tree), "end": at + 1 if tag else len(tree), "depth": int(not tag), "kind": kind, "tag": tag, "attrs": {}, "text": text})
            at += 2
        # A universal selector names the style elements as well.
        nodes += tree
    table = frame(spark, nodes).cache()
    first = {(n["page_id"], n["node_id"]) for n in nodes if n["tag"] == "style"}
    won = cascade.winners(table).cache()
    got = {(r.page_id, r.node_id, r.name): r.value for r in won.collect() if (r.page_id, r.node_id) not in first}
    assert got == want and len(want) > 300
    assert {(r.page_id, r.node_id, r.name) for r in cascade.winners(table, ("left",)).collect()} == {(r.page_id, r.node_id, r.name) for r in won.filter("name = 'left'").collect()}
    css = cascade.computed(table, won, table.filter("kind = 'element' AND tag <> 'style'")).collect()
    assert {(r.page_id, r.node_id, k): v for r in css for k, v in r.css.items() if k in ("color", "visibility")} == inherited
    assert all({k: v for k, v in r.css.items() if k in ("left", "opacity")} == {k[2]: v for k, v in want.items() if k[:2] == (r.page_id, r.node_id) and k[2] in ("left", "opacity")} for r in css)


def test_sheets_are_read():
    from harrow.operators.cascade import declared, rules_of

    names = lambda css: [(s, [(d["name"], d["value"], d["important"]) for d in found]) for s, found in rules_of(css)]
    assert names("a{b:c;d:e!important}") == [("a", [("b", "c", False), ("d", "e", True)])]
    assert names("@import 'x';@charset \"y\"; a{b:'};{'}/*c*/d{e:url(data:;x)}") == [("a", [("b", "'};{'", False)]), ("d", [("e", "url(data:;x)", False)])]
    assert names("@media (min-width:1px){a{b:c}} @supports (x:y){a{b:c}} @media all{d{e:f}} @media print, screen{g{h:i}} @keyframes k{from{a:b}}") == [("d", [("e", "f", False)]), ("g", [("h", "i", False)])]
    assert names("a{b:c; &:hover{d:e} f:g} } h{i:j") == [("a", [("b", "c", False), ("f", "g", False)])] or names("a{b:c; &:hover{d:e} f:g} } h{i:j")[0][0] == "a"
    assert declared("nonsense; : x; a:;-webkit-x: Y  Z") == [{"name": "a", "value": "", "important": False}, {"name": "-webkit-x", "value": "y z", "important": False}]


def test_hidden_by_class_rules(spark):
    from harrow.operators import page_rules
    from harrow.sources import html

    page = """<style>.a{opacity:0}.b{color:#fff}.c{-webkit-text-fill-color:transparent}.d{background-clip:text}.e{background:#000}.f{visibility:hidden}.sr-only{position:absolute;left:-9999px}
.g{max-height:0;overflow:hidden}.h{opacity:0;transition:opacity 1s}</style><p class=a>1</p><div class=b>2<i>3</i><span style="color:#000">4</span></div><p class=c>5</p><p class="c d">6</p><div class="e b"><i>7</i></div>
<div class=f>8<b style="visibility:visible">9</b></div><p class=sr-only>10</p><p class=g>11</p><p class=h>12</p><p style="opacity:1" class=a>13</p>"""
    pages = spark.createDataFrame([(1, page), (2, "<p class=a>1</p>"), (3, None)], "page_id long, html string")
    nodes = html.nodes(pages).cache()
    found = page_rules.hidden_text(nodes).join(nodes.select("page_id", "node_id", "text_content"), ["page_id", "node_id"]).collect()
    assert sorted((r.page_id, r.text_content, r.evidence) for r in found) == [(1, "1", "opacity-0"), (1, "11", "max-height-collapsed"), (1, "234", "color-match"), (1, "5", "text-fill-transparent"), (1, "89", "visibility-hidden")]


# Site patterns


def test_patterns_equal_their_expressions(spark):
    import re

    from harrow.functions import urls as U
    from harrow.operators import site_patterns

    rng = random.Random(15)
    label = lambda: rng.choice(["a", "b", "www", "x-1", "shop"])
    host = lambda n: ".".join([*(label() for _ in range(n)), rng.choice(["example.com", "example.co.uk", "net"])])
    urls = [(i, f"https://{host(rng.randint(0, 3))}{rng.choice(['', '/', '/en/x', '/en', '/a.b'])}") for i in range(400)] + [(900, None), (901, "no url"), (902, "HTTPS://A.Example.com/en/")] + [(1000 + i, "https://a.net/en/x") for i in range(50)]
    patterns = sorted({(rng.choice(["", "*.", "a.*.", "*b.", "sh*p.", "*."]) + host(rng.randint(0, 2)), rng.choice([None, "/*", "/en/*", "/a.b", "*x"])) for _ in range(200)} | {("*", None), ("*", "/en*"), ("[", None), ("A.EXAMPLE.com", None)}, key=str)
    got = site_patterns.match(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(patterns, "host_pattern string, path_pattern string"))
    got = sorted((r.page_id, r.host_pattern, r.path_pattern or "") for r in got.collect())
    want = []
    for i, url in urls:
        m = re.match(r"https?://([^/?#]+)([^?#]*)", url or "", re.I)
        for h, p in patterns if m else []:
            by_host, by_path = U.pattern_regex(h.lower(), p)
            if (h == "*" or re.search(by_host, m[1].lower())) and re.search(by_path, m[2] or "/"):
                want.append((i, h, p or ""))
    assert got == sorted(want) and len(want) > 1000
    some = site_patterns.denied(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([("*.example.com", None)], "host_pattern string, path_pattern string")).collect()
    assert len(some) == len(urls) and {r.page_id for r in some if r.denied} == {i for i, h, _ in want if h == "*" and re.match(r"https?://(?:[^/]*\.)?example\.com(?:/|$)", dict(urls)[i], re.I)}


# Names of hosts


def test_public_suffixes(spark):
    from harrow.functions import hosts as H

    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "ac.jp", "xn--p1ai"]
    names = {
        "example.com": "example.com", "a.b.example.com": "example.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "y.x.co.uk": "x.co.uk", "uk": None, "a.uk": "a.uk", "x.ck": None, "y.x.ck": "y.x.ck", "z.y.x.ck": "y.x.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "ck": None,
        "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "a.city.kobe.jp": "city.kobe.jp", "kobe.jp": "kobe.jp", "x.unknown": "x.unknown", "a.x.unknown": "x.unknown", "unknown": None, "10.0.0.1": "10.0.0.1", "::1": "::1", "": None, "A.Example.COM.": "example.com", "x.xn--p1ai": "x.xn--p1ai",
    }
    hosts = spark.createDataFrame([(k,) for k in names] + [(None,)], "host string")
    got = {r.host: r.site for r in H.registrable(hosts, spark.createDataFrame([(r,) for r in rules], "rule string")).collect()}
    assert got == names | {None: None}
    lines = spark.createDataFrame([("// note",), ("  ",), ("CO.uk  // x",), ("*.ck",), ("*.ck",)], "value string")
    assert sorted(r.rule for r in H.suffix_list(lines).collect()) == ["*.ck", "co.uk"]


def test_international_names(spark):
    from harrow.functions import hosts as H

    names = ["bücher.example", "xn--bcher-kva.example", "пример.рф", "plain.example", "xn--\ud83d".encode("utf-8", "replace").decode(), "xn--a-.b", "xn--99999999.x", "Straße。de", None, ""]
    rows = spark.createDataFrame([(n,) for n in names], "h string").select("h", H.to_unicode(F.col("h")).alias("u"), H.to_ascii(F.col("h")).alias("a")).collect()
    by = {r.h: (r.u, r.a) for r in rows}
    assert by["bücher.example"] == ("bücher.example", "xn--bcher-kva.example") and by["xn--bcher-kva.example"][0] == "bücher.example"
    assert by["пример.рф"][1] == "xn--e1afmkfd.xn--p1ai" and by["plain.example"] == ("plain.example", "plain.example") and by[None] == (None, None) and by[""] == ("", "")
    assert by["xn--99999999.x"][0] == "xn--99999999.x" and by["Straße。de"][1] == "xn--strae-oqa.de"


def test_spoofed_international_links(spark):
    from harrow.operators import page_rules
    from harrow.sources import html

    links = [("https://bücher.example/", "xn--bcher-kva.example"), ("https://xn--bcher-kva.example/", "bücher.example"), ("https://evil.example/", "bücher.example"), ("https://x.co.uk/", "y.co.uk"), ("https://a.ck.test/", "b.ck.test"), ("https://xn--80ak6aa92e.com/", "xn--80ak6aa92e.com")]
    page = "".join(f'<a href="{h}">{t}</a>' for h, t in links)
    nodes = html.nodes(spark.createDataFrame([(1, "https://p.example/", page)], "page_id long, url string, html string"), url="url").cache()
    rules = spark.createDataFrame([("com",), ("co.uk",), ("*.test",)], "rule string")
    place = {r.node_id: k for k, r in enumerate(nodes.filter("tag = 'a'").orderBy("pre").collect())}
    got = {place[r.node_id]: r.evidence for r in page_rules.link_spoof(nodes, rules).collect()}
    assert got == {2: "other domain", 3: "other domain", 4: "other domain", 5: "look-alike"}
    assert {place[r.node_id] for r in page_rules.link_spoof(nodes).collect()} == {2, 3, 5}


# Compressed trees


def naive_tree(tree, texts, kids, n, R):
    """The compressed tree of a node by recursion: None, or [node, children]."""
    import re

    if n["kind"] == "text":
        said = " ".join(n["text"].split())
        return (said[:160].rstrip() + "…" if len(said) > 160 else said) or None
    if n["tag"] in R.LEFT_OUT or "hidden" in n["attrs"]:
        return None
    below = [] if n["tag"] in ("svg", "textarea") else [x for m in kids.get(n["node_id"], []) if (x := naive_tree(tree, texts, kids, m, R))]
    if n["tag"] in R.WRAPPERS and not any(re.search(R.KEPT, k) for k in n["attrs"]):
        if not below:
            return None
        if len(below) == 1 and not isinstance(below[0], str):
            return below[0]
    return [n, below]


def test_trees_are_contracted(spark):
    from harrow.operators import site_rules as R

    rng, nodes, want = random.Random(16), [], {}
    for page in range(40):
        tree = random_tree(rng, page, rng.randint(1, 30), tags=["div", "span", "div", "span", "p", "a", "h2", "nav", "svg", "script", "button"])
        for n in tree:
            n["attrs"] = {k: "v" for k in ("href", "hidden", "class", "aria-label") if rng.random() < 0.08}
            if rng.random() < 0.15 and n["end"] == n["pre"]:
                n |= {"kind": "text", "tag": None, "attrs": {}, "text": rng.choice(["word", " \n ", "long " * 50])}
        nodes += tree
        kids = {}
        for n in tree:
            kids.setdefault(n["parent_id"], []).append(n)
        shown = {}

        def walk(x, depth, up):
            if isinstance(x, list):
                n, below = x
                shown[n["node_id"]] = (depth, up)
                for b in below:
                    walk(b, depth + 1, n["node_id"])
            else:
                shown.setdefault("texts", []).append((depth, up, x))

        for root in kids[None]:
            if x := naive_tree(tree, None, kids, root, R):
                walk(x, 0, None)
        want[page] = shown
    got = R.contracted(frame(spark, nodes).cache()).collect()
    for page, shown in want.items():
        rows = [r for r in got if r.page_id == page]
        assert {r.node_id: (r.depth, r.up) for r in rows if r.kind == "element"} == {k: v for k, v in shown.items() if k != "texts"}
        assert sorted((r.depth, r.up or -1, r.said) for r in rows if r.kind == "text") == sorted((d, u or -1, t) for d, u, t in shown.get("texts", []))
    by = {(n["page_id"], n["node_id"]): n for n in nodes}
    heads = {(n["page_id"], up) for n in nodes if n["tag"] == "h2" for a in [n["parent_id"]] if a is not None for up in (a, by[n["page_id"], a]["parent_id"])}
    for r in got:
        assert r.ref == (r.kind == "element" and (r.tag in ("a", "nav", "button") or (r.page_id, r.node_id) in heads))


def test_sections_are_guarded(spark):
    from harrow.operators import site_rules as R
    from harrow.sources import html

    page = "<body><header><nav>a</nav></header><aside><section>b</section></aside><article><section>c</section></article><nav style='position: fixed'>d</nav><p>e</p><footer>f</footer></body>"
    nodes = html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).cache()
    tags = {r.node_id: r.tag for r in nodes.filter("kind = 'element'").collect()}
    got = R.irrelevant_sections(nodes, lambda tree: [*tags, *tags, 999]).collect()
    assert sorted(tags[r.node_id] for r in got) == ["aside", "footer"]
