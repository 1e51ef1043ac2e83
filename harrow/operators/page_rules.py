"""Rules over the node table. Each takes nodes with the page's url and yields detections: page_id, node_id, evidence.

What a browser would know at run time (computed style, layout, script effects) is judged from inline style, attributes
and source text; rules that do so say "approximation". ``RULES`` is the catalog, in order of evaluation; every rule
looks at the original page ("independent" mode).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import colour as C
from harrow.functions import hosts as H
from harrow.functions import text as X
from harrow.functions import urls as U
from harrow.operators import cascade as K
from harrow.operators import dom as D
from harrow.operators import entities as N
from harrow.operators import selectors as S
from harrow.operators import site_patterns as P
from harrow.operators import text_rules as R
from harrow.session import shared_table

FORMS = "text|email|search|tel|url|number|password"


@dataclass(frozen=True)
class Local:
    """A rule that looks at one node at a time: ``hit`` gives predicate and evidence; of hits within each other, ``post``
    keeps the outermost or the innermost. ``detect`` looks at each node once for all such rules."""

    hit: Callable[[], tuple[Column, Column | str]]
    post: str = ""

    def __call__(self, n: DataFrame) -> DataFrame:
        found = _found(n, *self.hit())
        return {"outermost": D.outermost, "innermost": D.innermost}[self.post](found, "page_id") if self.post else found


def local(post: str = "") -> Callable[[Callable], Local]:
    return lambda hit: Local(hit, post)


def _found(nodes: DataFrame, where: Column, evidence: Column | str) -> DataFrame:
    e = F.lit(evidence) if isinstance(evidence, str) else evidence
    return nodes.filter(where).select("page_id", "node_id", "pre", "end", e.cast("string").alias("evidence"))


def _element(*tags: str) -> Column:
    return (F.col("kind") == "element") & F.col("tag").isin(*tags)


def _small(limit: int, children: int) -> Column:
    return (F.col("kind") == "element") & ~F.col("in_non_content") & ~F.col("tag").isin("script", "style", "noscript", "template") & (F.col("n_children") <= children) & (F.length("text_content") > 0) & (F.col("text_len") <= limit)


def styled(n: DataFrame) -> DataFrame:
    """Nodes with the inline style, lower case and without spaces around its marks, in _style for ``style``."""
    return n.withColumn("_style", F.lower(F.regexp_replace(F.coalesce(D.attr("style"), F.lit("")), r"\s*([:;,])\s*", "$1")))


def style(name: str) -> Column:
    """A property of the inline style."""
    return F.nullif(F.regexp_extract("_style", rf"(?:^|;){name}:([^;]+)", 1), F.lit(""))


def personal_data(n: DataFrame) -> DataFrame:
    g = D.inline_groups(n, 9)
    # The shortest span has nine digits, no more than three characters apart.
    g = g.filter(F.col("text").rlike("(?:[0-9][^0-9]{0,3}){9}")).withColumn("s", F.explode_outer(R.personal_spans(F.col("text")))).filter("s IS NOT NULL")
    # The node in which the span begins.
    seek = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("node_id"), F.lit(None).cast("int").alias("pre")), lambda a, p: F.struct((a["at"] + F.length(p["text"])).alias("at"), F.when(a["at"] <= F.col("s.start"), p["node_id"]).otherwise(a["node_id"]).alias("node_id"), F.when(a["at"] <= F.col("s.start"), p["pre"]).otherwise(a["pre"]).alias("pre")))
    g = g.withColumn("_n", seek)
    return g.select("page_id", "_n.node_id", "_n.pre", F.col("_n.pre").alias("end"), F.col("s.label").alias("evidence"))


@local()
def secrets():
    return ((F.col("kind") == "text") & ~F.col("in_non_content") & R.any_of(F.col("text"), R.SECRETS.values()), "secret")


@local()
def encoded():
    return ((F.col("kind") == "text") & ~F.col("in_non_content") & (F.length("text") >= 40) & R.any_encoded(F.col("text")), "encoded")


@local()
def invisible():
    # None of these characters is ASCII.
    seen = lambda s: (F.octet_length(s) > F.length(s)) & s.rlike(X.INVISIBLE_CLASS)
    return (F.coalesce(seen(F.col("text")), F.lit(False)) | F.exists(F.map_values(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), seen), "invisible")


def prompt_injection(n: DataFrame) -> DataFrame:
    hit = n.filter((F.col("kind") == "text") & ~F.col("in_non_content") & ~F.col("in_svg") & (F.length("text") >= 8) & R.injected(F.col("text")))
    block = n.select("page_id", F.col("node_id").alias("nearest_block"), F.col("pre").alias("b_pre"), F.col("end").alias("b_end"), F.col("tag").alias("b_tag"))
    held = hit.select("page_id", "nearest_block", "text").join(block, ["page_id", "nearest_block"]).filter(~F.col("b_tag").isin("html", "body"))
    return held.groupBy("page_id", F.col("nearest_block").alias("node_id"), F.col("b_pre").alias("pre"), F.col("b_end").alias("end")).agg(F.min("text").alias("evidence"))


@local()
def comments_injected():
    return ((F.col("kind") == "comment") & ~F.col("in_non_content") & R.injected(F.col("text")), F.col("text"))


@local()
def noscript():
    return (_element("noscript") & (F.col("end") > F.col("pre")), "noscript")


@local()
def svg_text():
    return (_element("title", "desc", "text") & F.col("in_svg") & R.injected(F.col("whole_text")), F.col("tag"))


@local()
def meta_injected():
    return ((_element("meta") & F.coalesce(R.injected(D.attr("content")), F.lit(False))) | (_element("title") & ~F.col("in_svg") & R.injected(F.col("whole_text"))), F.col("tag"))


def visible_attributes(attrs: Column) -> Column:
    """Attributes without characters that show nothing."""
    return F.transform_values(attrs, lambda k, v: X.strip_invisible(v))


#: Attributes that carry text a reader does not see at once.
CARRIERS = ("alt", "title", "placeholder", "aria-label", "aria-description", "aria-valuetext", "summary", "label", "data-description", "content")


def bad_attributes(attrs: Column) -> Column:
    return F.map_filter(attrs, lambda k, v: k.isin(*CARRIERS) & R.injected(v))


@local()
def attributes_injected():
    e = (F.col("kind") == "element") & (F.col("tag") != "meta")
    hidden = _element("input") & ((D.attr("type") == "hidden") | D.attr("disabled").isNotNull()) & R.injected(D.attr("value"))
    bad = F.array_sort(F.map_keys(bad_attributes(F.col("attrs"))))
    return e & ((F.size(bad) > 0) | F.coalesce(hidden, F.lit(False))), F.array_join(bad, ",")


def _blank(value, test: Callable[[str], bool]):
    if isinstance(value, str):
        return "" if test(value) else value
    if isinstance(value, list):
        return [_blank(v, test) for v in value]
    return {k: _blank(v, test) for k, v in value.items()} if isinstance(value, dict) else value


def clean_json(text: Column, changed: bool = False) -> Column:
    """JSON with every string value that matches an injection family, once it is decoded, blanked; null where it is no JSON, and with
    ``changed`` where none does. Keys stay."""
    import re

    loose, cased = re.compile("(?i)(?:" + "|".join(R.INJECTION.values()) + ")"), re.compile("|".join(R.INJECTION_CASED.values()))

    def one(s: str | None) -> str | None:
        try:
            value = None if s is None else json.loads(s)
        except ValueError:
            return None
        blank = _blank(value, lambda v: bool(loose.search(v) or cased.search(v)))
        return None if s is None or (changed and blank == value) else json.dumps(blank, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


def _ld_json(n: DataFrame) -> DataFrame:
    script = n.filter(_element("script") & (F.lower(D.attr("type")) == "application/ld+json")).select("page_id", "node_id", "pre", "end", *(["url"] if "url" in n.columns else []))
    text = n.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("node_id"), F.col("text").alias("json"))
    return script.join(text, ["page_id", "node_id"])


def json_ld(n: DataFrame) -> DataFrame:
    made = _ld_json(n).withColumn("evidence", clean_json(F.col("json"), changed=True))
    return made.filter("evidence IS NOT NULL").select("page_id", "node_id", "pre", "end", "evidence")


def schema_trust(n: DataFrame) -> DataFrame:
    """Structured data that names an authority, or a person in the place of one, under another registrable domain than the page's."""
    found = N.untrusted(N.entities(n))
    return found.groupBy("page_id", "node_id").agg(F.min("pre").alias("pre"), F.min("end").alias("end"), F.min("claim").alias("evidence"))


#: Colours that are nearer to each other can't be told apart: a fixed value.
COLOUR_DISTANCE = 24


#: Properties by which text is hidden.
HIDING = (
    "display", "visibility", "opacity", "font-size", "position", "left", "top", "text-indent", "clip-path", "clip", "-webkit-text-fill-color", "background-clip", "filter", "mask-image", "transform", "content-visibility", "max-height", "overflow",
    "overflow-y", "color", "background-color", "background", "animation", "transition",
)


def cascaded(n: DataFrame) -> DataFrame:
    """Elements with text that a declaration of HIDING reaches, by a style sheet, the style attribute or inheritance: _style
    (what ``style`` reads), _own_text (whether text stands in them itself) and _ground, the colour behind it.

    That is the nearest background of the element or an ancestor that isn't clear, white where there is none; a
    background that is no plain colour is itself, so it matches nothing.
    """
    won = shared_table(K.winners(n, HIDING), "winners")
    element = n.filter((F.col("kind") == "element") & ~F.col("in_non_content") & (F.length("text_content") > 0))
    # Pages without such declarations are left out.
    some = K.computed(n, won, element.join(won.select("page_id").distinct(), "page_id", "left_semi")).filter(F.size("css") > 0)
    said = F.array_join(F.transform(F.map_entries("css"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    some = some.withColumn("_style", F.regexp_replace(said, r"\s*([:;,])\s*", "$1"))
    pictures = won.filter("name IN ('background', 'background-color')").groupBy("page_id", "node_id").agg(F.coalesce(F.max(F.when(F.col("name") == "background", F.col("value"))), F.max("value")).alias("_back"))
    opaque = F.coalesce(C.parse(F.col("_back"))["a"] >= 0.999, F.lit(True))
    grounds = pictures.filter(opaque).join(n.select("page_id", "node_id", "pre", "end"), ["page_id", "node_id"])
    held = D.nearest(some, grounds, "_ground", F.col("_back")).withColumn("_ground", F.coalesce("_ground", F.lit("#ffffff")))
    own = n.filter((F.col("kind") == "text") & (F.length(F.btrim("text")) > 0)).select("page_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_own", F.lit(True))
    return held.join(own, ["page_id", "node_id"], "left").withColumn("_own_text", F.coalesce("_own", F.lit(False))).drop("_own")


#: Reason and predicate of hidden text, first match wins; what style sheets and inline style say.
def hidden_reason() -> Column:
    px = lambda p: F.regexp_extract(style(p), r"^(-?[0-9.]+)px", 1).try_cast("double")
    live = D.attr("aria-live").isNotNull() | D.attr("role").isin("alert", "status", "log", "timer", "marquee")
    away = style("position").isin("absolute", "fixed")
    animated = style("animation").isNotNull() | style("transition").isNotNull()
    reasons = [
        ("display-none-live-region", (style("display") == "none") & live), ("visibility-hidden", style("visibility") == "hidden"), ("visibility-collapse", style("visibility") == "collapse"),
        ("opacity-0", (style("opacity").try_cast("double") == 0) & ~animated), ("font-size-0", F.col("_own_text") & style("font-size").rlike(r"^0(?:px|em|rem|%)?\s*$")),
        ("offscreen-left", away & (px("left") <= -9999)), ("offscreen-top", away & (px("top") <= -9999)), ("text-indent", px("text-indent") <= -9999),
        ("clip-to-zero", style("clip-path").rlike(r"inset\((?:50|100)%") | style("clip").rlike(r"rect\(0(?:px)?[, ]+0(?:px)?[, ]+0")), ("text-fill-transparent", F.col("_own_text") & (C.parse(style("-webkit-text-fill-color"))["a"] == 0) & ~(F.coalesce(style("background-clip"), F.lit("")) == "text")),
        ("filter-opacity-0", style("filter").rlike(r"opacity\(0%?\)") & ~animated), ("mask-transparent", style("mask-image").rlike(r"gradient\(\s*transparent\s*,\s*transparent")),
        ("transform-collapsed", style("transform").rlike(r"scale[xy]?\(0\)|scale\(0[, ]") & ~animated), ("content-visibility-hidden", style("content-visibility") == "hidden"),
        ("max-height-collapsed", style("max-height").rlike(r"^0(?:px|em|rem|%)?\s*$") & (F.coalesce(style("overflow") == "hidden", F.lit(False)) | (style("overflow-y") == "hidden")) & ~animated), ("color-match", F.col("_own_text") & (C.parse(style("color"))["a"] > 0) & (C.distance(C.parse(style("color")), C.parse(F.col("_ground"))) <= COLOUR_DISTANCE)),
    ]
    return F.coalesce(*[F.when(F.coalesce(p, F.lit(False)), F.lit(r)) for r, p in reasons])


def not_exempt(hit: Column) -> Column:
    """The reason, unless the node is for screen readers, or a landmark and hidden by position alone."""
    positional = ("offscreen-left", "offscreen-top", "text-indent", "clip-to-zero")
    exempt = F.coalesce(D.attr("class"), F.lit("")).rlike(r"(?:^|\s)(?:sr-only|visually-?hidden|screen-reader-text)(?:\s|$)")
    landmark = F.col("tag").isin("nav", "main", "header", "footer", "aside") | (D.attr("aria-hidden") == "true")
    return F.when(~exempt & ~(hit.isin(*positional) & F.coalesce(landmark, F.lit(False))), hit)


def hidden_text(n: DataFrame) -> DataFrame:
    e = cascaded(n).withColumn("_hit", hidden_reason()).filter("_hit IS NOT NULL").withColumn("evidence", not_exempt(F.col("_hit")))
    return D.outermost(e.filter("evidence IS NOT NULL").select("page_id", "node_id", "pre", "end", "evidence"), "page_id")


@local()
def cross_origin_frames():
    frame = _element("iframe", "object", "embed")
    src = F.when(_element("iframe") & D.attr("srcdoc").isNull(), D.attr("src")).when(_element("object"), D.attr("data")).when(_element("embed"), D.attr("src"))
    there = U.origin(U.resolve(src, F.col("url")))
    return (F.coalesce(F.when(frame, there.rlike("^https?:") & (there != U.origin(F.col("url")))), F.lit(False)), F.when(frame, there))


def links(n: DataFrame) -> DataFrame:
    """Links with their absolute URL and text."""
    return n.filter(_element("a") & D.attr("href").isNotNull()).select("page_id", "node_id", "pre", "end", "url", U.resolve(D.attr("href"), F.col("url")).alias("href"), F.col("whole_text").alias("said"))


def link_spoof(n: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Links whose text mixes scripts, looks like another domain or names another one than they lead to. International names
    are compared in their ASCII form. ``suffixes`` (rule) is a list of public suffixes; without one U.SUFFIXES count."""
    domain = r"(?:^|[\s(])(?:https?://)?((?:[\p{L}\p{N}-]+\.)+(?:\p{L}{2,24}|xn--[a-z0-9-]+))(?:[/\s)]|$)"
    mixed = F.col("said").rlike(r"[A-Za-z][Ͱ-ϿЀ-ӿ԰-֏Ꭰ-᏿]|[Ͱ-ϿЀ-ӿ԰-֏Ꭰ-᏿][A-Za-z]")
    a = links(n).withColumns({"_said": F.regexp_extract(F.lower("said"), domain, 1), "_mixed": mixed}).filter((F.col("_said") != "") | F.col("_mixed"))
    web = F.col("href").rlike("(?i)^https?:")
    a = a.withColumns({"_shown": H.to_unicode(F.col("_said")), "_from": H.to_ascii(F.nullif("_said", F.lit(""))), "_to": H.to_ascii(F.when(web, U.host(F.col("href"))))})
    if suffixes is None:
        a = a.withColumns({"_from": U.registrable(F.col("_from")), "_to": U.registrable(F.col("_to"))})
    else:
        a = H.registrable(H.registrable(a, suffixes, "_from", "_a"), suffixes, "_to", "_b").drop("_from", "_to").withColumnsRenamed({"_a": "_from", "_b": "_to"})
    alike = (F.col("_said") != "") & (X.skeleton(F.col("_shown")) != F.col("_shown")) & X.skeleton(F.col("_shown")).rlike("^[a-z0-9.-]+$")
    reason = F.when(F.col("_mixed"), "mixed script").when(alike, "look-alike").when(F.col("_from") != F.col("_to"), "other domain")
    return a.withColumn("evidence", reason).filter("evidence IS NOT NULL").select("page_id", "node_id", "pre", "end", "evidence")


#: Who gives a badge, by what it says, and what badges say that no one gives: fixed values.
ISSUERS = {
    "bbb accredited": "bbb.org", "better business bureau": "bbb.org", "norton secured": "norton.com", "norton by symantec": "norton.com", "mcafee secure": "mcafee.com", "trustpilot": "trustpilot.com", "trustwave": "trustwave.com",
    "godaddy verified": "godaddy.com", "godaddy secured": "godaddy.com", "digicert": "digicert.com", "comodo secure": "comodo.com", "geotrust": "geotrust.com", "symantec secured": "symantec.com", "verisign secured": "verisign.com",
    "sectigo": "sectigo.com", "truste certified": "truste.com", "globalsign": "globalsign.com", "authorize.net": "authorize.net", "paypal verified": "paypal.com", "shopify secure": "shopify.com",
}
GENERIC_BADGES = ("verified seller", "trusted seller", "verified store", "trusted store", "certified seller", "official store", "verified merchant", "trusted merchant", "secure checkout", "ssl secured", "100% secure", "safe shopping guarantee")
NAME_CAP = 120


def accessible_names(n: DataFrame, of: DataFrame) -> DataFrame:
    """Elements ``of`` with name: the first of aria-label, the texts that aria-labelledby names, an svg's title or an image's alt, and
    the title attribute that says something; null for none."""
    said = lambda c: F.nullif(F.btrim(c), F.lit(""))
    by_id = D.labelled_by(n, of)
    title = n.filter(_element("title") & F.col("in_svg")).groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.min_by("whole_text", "pre").alias("_title"))
    out = of.join(by_id, ["page_id", "node_id"], "left").join(title, ["page_id", "node_id"], "left")
    own = F.when(F.col("tag") == "svg", said(F.col("_title"))).when(F.col("tag") == "img", said(D.attr("alt")))
    return out.withColumn("name", F.coalesce(said(D.attr("aria-label")), said(F.col("label")), own, said(D.attr("title")))).drop("label", "_title")


def trust_badges(n: DataFrame) -> DataFrame:
    """Images that say they are a seal or that a shop is safe, but for a named issuer's on its own pages."""
    image = _element("img", "svg") | ((F.col("kind") == "element") & (D.attr("role") == "img"))
    named = accessible_names(n, n.filter(image & ~F.col("in_non_content"))).filter(F.length("name") <= NAME_CAP)
    quoted = "|".join(p.replace(".", r"\.") for p in (*ISSUERS, *GENERIC_BADGES))
    phrase = F.regexp_extract(F.lower("name"), rf"(?<![a-z0-9_])({quoted})(?![a-z0-9_])", 1)
    issuer = F.try_element_at(F.create_map(*[F.lit(x) for pair in ISSUERS.items() for x in pair]), phrase)
    own = F.coalesce(issuer == U.registrable(U.host(F.col("url"))), F.lit(False))
    return _found(named, (phrase != "") & ~own, F.col("name"))


def webdriver_probe(n: DataFrame) -> DataFrame:
    """Approximation: a script's source reads the property."""
    s = n.filter(_element("script")).select("page_id", "node_id", "pre", "end")
    t = n.filter((F.col("kind") == "text") & F.contains("text", F.lit("navigator.webdriver"))).select("page_id", F.col("parent_id").alias("node_id"))
    return s.join(t, ["page_id", "node_id"], "left_semi").withColumn("evidence", F.lit("navigator.webdriver"))


@local()
def closed_shadow():
    """Approximation: a declared closed root, or a custom element without content."""
    return ((_element("template") & (D.attr("shadowrootmode") == "closed")) | ((F.col("kind") == "element") & F.contains("tag", F.lit("-")) & (F.col("end") == F.col("pre"))), F.col("tag"))


def _selected(selector: str, evidence: str, but: tuple[str, ...] = ()) -> Local:
    """Elements that a selector names, on pages of other sites than ``but``."""
    asked = D.asked_attributes(selector)

    def hit() -> tuple[Column, str]:
        some = F.arrays_overlap(F.map_keys("attrs"), F.array(*map(F.lit, asked))) if asked else F.lit(True)
        here = D.selector(selector)
        if but:
            here = here & ~F.coalesce(U.registrable(U.host(F.col("url"))).isin(*but), F.lit(False))
        # Most elements have none of the attributes that are asked for.
        return F.coalesce(F.when((F.col("kind") == "element") & some, here), F.lit(False)), evidence

    return Local(hit, "outermost")


def by_site(n: DataFrame, sites: DataFrame) -> DataFrame:
    """Nodes that the selectors of their page's site name: page_id, rule_id, node_id, pre, end, evidence (the selector).

    ``sites`` (rule_id, host_pattern, path_pattern, selector) may be of any length: selectors are tried by their tokens, and
    what they name meets the sites by selector and host suffix.
    """
    named = S.match(n, sites.select("selector"))
    pages = n.select("page_id", "url").distinct().select("page_id", U.host(F.col("url")).alias("_host"), U.path(F.col("url")).alias("_path"))
    keyed = sites.select("rule_id", "host_pattern", "path_pattern", "selector", P.key(F.col("host_pattern")).alias("_key")).distinct()
    each = named.join(pages, "page_id").withColumn("_key", F.explode(P.suffixes(F.coalesce("_host", F.lit("")))))
    # A page without a host has the empty suffix alone, twice.
    each = each.drop("specificity").distinct()
    everywhere = (F.col("host_pattern") == "*") & P.path_fits(F.col("_path"), F.col("path_pattern"))
    here = each.join(keyed, ["selector", "_key"]).filter(P.fits(F.col("_host"), F.col("_path"), F.col("host_pattern"), F.col("path_pattern")) | F.coalesce(everywhere, F.lit(False)))
    best = here.groupBy("page_id", "rule_id", "node_id").agg(F.min("pre").alias("pre"), F.min("end").alias("end"), F.min("selector").alias("evidence"))
    return D.outermost(best, "page_id", "rule_id").select("page_id", "rule_id", "node_id", "pre", "end", "evidence")


COMMENTS = ", ".join((
    "#comments", "#comment-section", "#comments-section", "#commentsection", "#comment-list", "#comments-area", "#disqus_thread", "#respond", ".comments", ".comment-list", ".commentlist", ".comments-area", ".comments-section", ".comment-section", ".comment-thread",
    ".fb-comments", ".js-discussion", "#coral_talk_stream", "#livefyre-comments", "#hyvor-talk-view", "#remark42", "#commento", "#giscus", ".giscus", ".utterances", "#isso-thread", "#graphcomment", "#spot-im-frame-inpage", "[data-spot-im-module]", "[data-component=comments]", "[data-testid=comments]", "section[aria-label=Comments]", "[itemtype*=schema.org/Comment]",
))
REVIEWS = "[itemtype*=schema.org/Review], #reviews, #customer-reviews, .customer-reviews, .review-list, .reviews-list, [data-hook=review], .yotpo-reviews, .bv-content-list"
SOCIAL = ", ".join((
    ".twitter-tweet", ".twitter-timeline", ".twitter-video", ".instagram-media", ".fb-post", ".fb-video", ".fb-page", ".tiktok-embed", ".reddit-embed", ".reddit-card", ".bluesky-embed", ".mastodon-embed", ".pinterest-embed", "[data-pin-do]",
    *(f"iframe[src*={h}]" for h in ("youtube.com/embed", "youtube-nocookie.com/embed", "player.vimeo.com", "twitter.com", "platform.x.com", "facebook.com/plugins", "instagram.com", "tiktok.com/embed", "open.spotify.com/embed", "w.soundcloud.com", "linkedin.com/embed")),
))
#: Sites whose own pages are made of such embeds: there they are content.
SOCIAL_HOSTS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "tiktok.com", "reddit.com", "bsky.app", "youtube.com", "vimeo.com", "pinterest.com", "spotify.com", "soundcloud.com", "linkedin.com")
COOKIES = ", ".join((
    "#onetrust-banner-sdk", "#onetrust-consent-sdk", "#CybotCookiebotDialog", ".cc-window", ".cc-banner", "#cookie-banner", "#cookiebanner", ".cookie-banner", ".cookie-consent", "#cookie-consent", "#cookie-notice", ".cookie-notice", "#cookie-law-info-bar",
    "#didomi-host", "#qc-cmp2-container", "#usercentrics-root", "#truste-consent-track", "#iubenda-cs-banner", "[id^=sp_message_container]", ".osano-cm-window", ".cky-consent-container", "#axeptio_overlay", ".fc-consent-root", "#hs-eu-cookie-confirmation", ".termly-styles-root",
))
CHAT = ", ".join((
    "#intercom-container", "#intercom-frame", ".intercom-lightweight-app", "#drift-widget", "#drift-frame-controller", ".zEWidget-launcher", "#launcher[title*=chat]", "#hubspot-messages-iframe-container", ".crisp-client", "#crisp-chatbox", "#chat-widget", "#chat-widget-container", "#tawkchat-container",
    "[id^=tawk_]", "#livechat-compact-container", "#olark-wrapper", "#tidio-chat", "#freshworks-container", "#fc_frame", ".fb_dialog", ".fb-customerchat", "#gorgias-chat-container", "#userlike", "#smooch-container", "#kommunicate-widget-iframe",
))
ADS = "ins.adsbygoogle, [data-ad-slot], [id^=google_ads_], [class*=sponsored-ad], .ad, .ads, .advert, .advertisement"
NEWSLETTER = "[role=dialog], .modal, .popup, [class*=newsletter]"
FOOTER = "footer, #footer, .site-footer, [role=contentinfo]"


@local("outermost")
def footer():
    return (D.selector(FOOTER) & ~F.col("in_article"), "footer")


def newsletter(n: DataFrame) -> DataFrame:
    held = _found(n, D.selector(NEWSLETTER) & F.coalesce(F.lower("whole_text").rlike("subscribe|sign ?up|newsletter|join our"), F.lit(False)), "newsletter")
    mail = n.filter(_element("input") & (D.attr("type") == "email")).select(F.col("page_id").alias("_p"), F.col("pre").alias("_m"))
    has = held.join(mail, (F.col("page_id") == F.col("_p")) & (F.col("_m") > F.col("pre")) & (F.col("_m") <= F.col("end")), "left_semi")
    return D.outermost(has, "page_id")


@local("innermost")
def scarcity():
    return (_small(80, 20) & R.scarce(F.col("text_content")), F.col("text_content"))


@local("innermost")
def timers():
    return (_small(64, 20) & F.col("text_content").rlike("[0-9]{1,2}:[0-9]{2}|[0-9]+ ?(?:hours?|hrs?|min|sec)") & X.timer_seconds(F.col("text_content")).isNotNull(), X.timer_seconds(F.col("text_content")))


def counting_down(snapshots: DataFrame) -> DataFrame:
    """Of (page_id, node_id, at, text) the nodes whose timer went down between two looks."""
    w = Window.partitionBy("page_id", "node_id").orderBy("at")
    s = snapshots.withColumn("seconds", X.timer_seconds(F.col("text"))).withColumn("before", F.lag("seconds").over(w))
    return s.filter(F.col("seconds") < F.col("before")).select("page_id", "node_id").distinct()


#: What a refusal is made to give up, what it is made to neglect, and what it is made to take.
BENEFIT = r"(?:discounts?|deals?|offers?|sav(?:e|ings?)|saving|coupons?|rewards?|bargains?|free|money|cash|perks?|benefits?|promotions?|updates?|news|good prices|protection|insurance|coverage)"
CARED_FOR = r"(?:famil(?:y|ies)|kids?|child(?:ren)?|safety|security|privacy|health|future|home|identity|data|accounts?|passwords?|finances?)"
EXPOSED = r"(?:unsafe|unprotected|exposed|vulnerable|at risk|in danger|hacked|breached|uninformed|ignorant)"
DEARER = r"(?:full|more|extra|retail|the full|\$[0-9]|[0-9]+ ?%)"
EARNED = r"(?:streak|progress|xp|points?|coins?|gems?|rank|level|score|badges?|achievements?|stats|gold|silver|platinum|vip|pro|premium|plus|elite|membership|benefits|perks|status|rewards)"
_NOT, _AM = "(?:don.?t|do not)", "i(?:.?m| am)"
#: What makes a refusal shameful; families of phrases. A plain refusal names none of the above.
SHAMING = (
    rf"\bi {_NOT} (?:want|like|love|need|value|care (?:about|for))\b.{{0,40}}\b{BENEFIT}\b", rf"\bi {_NOT} (?:care about|(?:want|need) to protect) (?:my |our |the )?{CARED_FOR}\b", rf"\bi {_NOT} deserve\b", rf"\bi (?:hate|dislike) {BENEFIT}\b",
    rf"\bi(?:.?d| would|.ll| will)? (?:rather|prefer(?: to)?) (?:keep )?(?:pay(?:ing)? {DEARER}|miss|not sav|be {EXPOSED})", rf"\b{_AM} (?:fine|ok(?:ay)?|happy|good) (?:with )?(?:paying|spending) {DEARER}", rf"\b{_AM} (?:fine|ok(?:ay)?|happy|good) without (?:the |my |any )?{BENEFIT}\b",
    rf"\b{_AM} (?:fine|ok(?:ay)?|happy) (?:with )?being {EXPOSED}\b", rf"\b{_AM} (?:not smart|not frugal|too (?:rich|smart|good) )|\b{_AM} not interested in {BENEFIT}\b", r"\bi (?:already )?know everything\b", rf"\bi (?:like|love|enjoy) (?:to )?(?:overpay|pay(?:ing)? {DEARER}|spending {DEARER}|missing out)",
    rf"\bi.?ll (?:pay {DEARER}|stay {EXPOSED}|miss out|pass on|risk)\b", rf"\b(?:skip|continue|proceed|go on|order)\b.{{0,40}}\b(?:and (?:miss|lose|pay {DEARER})|without (?:my |the )?{BENEFIT})\b", r"\bmaybe never\b", r"\bi (?:accept|take) the risk\b",
    rf"\b(?:leave|stay|remain|be) (?:(?:me|my|our) ?\w* )?{EXPOSED}\b", r"\bdowngrade (?:to|me|my)\b", rf"\b(?:lose|forfeit|give up|drop|remove|abandon|sacrifice|throw away) (?:all )?(?:of )?my (?:\w+ )?{EARNED}\b", rf"\byes,? (?:lose|reset|forfeit|sacrifice)\b.{{0,20}}\b(?:{EARNED}|days?|months?|years?)\b",
    rf"\b(?:make|let|force) me (?:to )?pay {DEARER}\b", rf"\bcharge me {DEARER}", r"\b(?:stop (?:trying to )?help(?:ing)?|don.?t help) me (?:save|win|earn|find|get|protect|with)\b", r"\b(?:sure|whatever|fine|alright|of course),? (?:charge me|take my (?:money|cash)|i love (?:spam|junk mail|paying|overpaying))",
    rf"\byes,? (?:skip|forfeit|lose|take away|remove|cancel|reject) (?:my|the) (?:{BENEFIT}|{EARNED})\b", rf"\byes,? (?:pay|charge me|spend) {DEARER}", rf"\bconfirm ?[:—-]? ?(?:pay|skip|forfeit|lose|charge) (?:{DEARER}|my|the)", r"\bi (?:choose|want) to (?:lose|miss)\b",
)
#: Characters of a label at most; what is longer is no label.
LABEL_CAP = 240


@local()
def confirmshame():
    whole = F.col("text_len") <= LABEL_CAP
    said = F.btrim(F.coalesce(F.when(_element("input"), D.attr("value")).otherwise(F.when(whole, F.col("text_content"))), F.lit("")))
    button = _element("button", "a") | (_element("input") & D.attr("type").isin("button", "submit", "reset")) | ((F.col("kind") == "element") & (D.attr("role") == "button"))
    plain = F.lower(F.regexp_replace(said, r"\s+", " "))
    return (F.coalesce(F.when(button, (F.length(said) <= LABEL_CAP) & plain.rlike("|".join(SHAMING))), F.lit(False)), said)


@local()
def checkout_boxes():
    return _element("input") & (D.attr("type") == "checkbox") & D.attr("checked").isNotNull() & D.attr("disabled").isNull() & U.is_checkout(F.col("url")), D.attr("name")


#: Labels of what is added to a cart, in order of precedence: fixed values. The expressions, and the labels after the tip's, are this repository's own.
ADDONS = {
    "protection plan": r"\bprotection plan\b", "warranty": r"\bwarrant(?:y|ies)\b", "service / care plan": r"\b(?:service|care) (?:plan|contract)s?\b", "SquareTrade": "square ?trade", "AppleCare": "apple ?care", "Asurion": r"\basurion\b", "insurance": r"\binsurance\b",
    "donation": r"\bdonat(?:e|ions?)\b", "round-up": r"\bround[ -]?up\b", "gift wrap": "gift ?(?:wrap|box)", "gift message": r"\bgift message\b", "carbon offset": "carbon[ -](?:offset|neutral)", "Route protection": r"\broute(?:\+| (?:package )?protection\b)", "Seel protection": r"\bseel (?:protection|assurance)\b",
    "Navidium protection": r"\bnavidium\b", "shipping / package protection": r"\b(?:package|shipping|order|delivery) protection\b", "driver / courier tip": r"\b(?:driver|courier) tip\b",
    "tip": r"\badd (?:a )?tip\b|gratuity", "subscription": "auto.?renew|subscri|autoship", "priority": "priority (?:boarding|processing|shipping|support)",
}


@local("innermost")
def cart_addons():
    low = F.lower("text_content")
    label = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in ADDONS.items()])
    return F.coalesce(F.when(_small(200, 40) & U.is_checkout(F.col("url")), label.isNotNull()), F.lit(False)), label


#: Fees that are told late, and how far up the summary of an order is looked for: fixed values.
FEES = ("service fee", "convenience fee", "processing fee", "resort fee", "destination fee", "facility fee", "handling fee", "venue fee", "delivery surcharge")
FEE_HOPS, PRICED_ROWS, AMOUNT_CAP, COUSINS, ROW_CAP = 8, 2, 40, 8, 100
MONEY = r"[$£€¥¢₹₩] ?[0-9][0-9,]*(?:\.[0-9]{1,2})?"
NO_FEE = r"\b(?:(?:sales )?tax|vat|gst|tip|gratuity|(?:shipping|delivery)(?! surcharge))\b"
TOTAL = r"\b(?:sub ?total|(?:grand |order )?total|amount due|balance|due now)\b"


def _money_alone(text: Column) -> Column:
    return text.rlike(rf"(?i)^{MONEY} ?(?:usd|eur|gbp|jpy|cad|aud)?$")


def fee_outcomes(n: DataFrame) -> DataFrame:
    """Fee labels on checkout pages with outcome and amount: page_id, node_id, pre, end, evidence (the amount), outcome.

    ``no-summary-ancestor``: no order summary within FEE_HOPS steps above, or something to use, to navigate by or that bounds the page stands
    between; ``no-adjacent-amount``: no amount in the label, beside it or beside its parent; ``single-item-cart``: the summary has
    fewer than PRICED_ROWS rows with a price that are no totals; else ``flagged``.
    """
    # The pages of checkouts are read some twenty times, the others once.
    c = shared_table(n.filter(U.is_checkout(F.col("url"))), "checkout")
    e = c.filter((F.col("kind") == "element") & ~F.col("in_non_content"))
    text, role = F.regexp_replace("text_content", r"\s+", " "), F.coalesce(D.attr("role"), F.lit(""))
    low = F.lower(text)
    fee = rf"^(?:{'|'.join(FEES)})(?:(?: ?[:—–|·(-] ?.{{0,60}})|(?: {MONEY}(?: .{{0,30}})?))?$"
    labels = D.innermost(c.filter(_small(80, 3) & low.rlike(fee) & ~low.rlike(NO_FEE)).select("page_id", "node_id", "parent_id", "pre", "end", "depth", F.nullif(F.regexp_extract(text, MONEY, 0), F.lit("")).alias("_in")), "page_id")
    live = labels.select("page_id").distinct()
    e = e.join(live, "page_id", "left_semi")
    named = D.labelled_by(c, e.filter(role == "region"))
    words = r"(?i)cart|order|checkout|basket|bag|summary|totals?|fees?|price-?details|billing"
    region = F.coalesce(F.nullif(D.attr("aria-label"), F.lit("")), F.col("label"), F.lit("")).rlike(r"(?i)\b(?:(?:order|cart|checkout|payment|billing) summary|fee breakdown|price details|order total)\b")
    kept = e.join(named, ["page_id", "node_id"], "left")
    summary = (F.col("tag") == "table") | ((role == "region") & region) | (F.col("tag").isin("aside", "section", "div", "ul", "ol") & F.concat_ws(" ", D.attr("class"), D.attr("id")).rlike(words)) | F.coalesce(D.attr("itemtype").rlike(r"(?i)\bOrder\b"), F.lit(False))
    barrier = F.col("tag").isin("button", "select", "option", "input", "textarea", "label", "nav", "header", "footer", "main", "body", "html") | role.isin("button", "tab", "menuitem", "option", "checkbox", "radio", "switch", "navigation", "banner", "contentinfo", "main")
    place = ("page_id", "node_id", "pre", "end", "depth")
    found = D.climb(labels, kept.filter(summary).select(*place), e.filter(barrier).select(*place), FEE_HOPS, "_box", strict=True)
    # Amounts that stand alone, beside the label or beside its parent.
    amount = e.filter((F.col("text_len") > 0) & (F.col("text_len") < AMOUNT_CAP) & _money_alone(text)).select("page_id", F.col("parent_id").alias("_up"), F.col("node_id").alias("_n"), F.struct(F.col("pre").alias("at"), F.col("text_content").alias("said")).alias("_a"))
    parents = e.select("page_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_grand"))
    grand = e.select("page_id", F.col("node_id").alias("_grand"), F.col("n_children").alias("_kids"))
    up = labels.select("page_id", "node_id", "parent_id").join(parents, ["page_id", "parent_id"]).join(grand, ["page_id", "_grand"], "left")
    beside = up.join(amount, (up["page_id"] == amount["page_id"]) & (F.col("parent_id") == F.col("_up")) & (F.col("_n") != F.col("node_id"))).groupBy(up["page_id"], "node_id").agg(F.min("_a")["said"].alias("_beside"))
    cousin = up.filter(F.col("_kids") <= COUSINS).join(amount, (up["page_id"] == amount["page_id"]) & (F.col("_grand") == F.col("_up")) & (F.col("_n") != F.col("parent_id"))).groupBy(up["page_id"], "node_id").agg(F.min("_a")["said"].alias("_cousin"))
    found = found.join(beside, ["page_id", "node_id"], "left").join(cousin, ["page_id", "node_id"], "left").withColumn("evidence", F.coalesce("_in", "_beside", "_cousin"))
    boxes = found.filter("_box IS NOT NULL").select("page_id", F.col("_box").alias("node_id")).distinct().join(e.select("page_id", "node_id", "pre", "end"), ["page_id", "node_id"])
    out = found.join(priced_rows(c, e, boxes).withColumnRenamed("node_id", "_box"), ["page_id", "_box"], "left")
    outcome = F.when(F.col("_box").isNull(), "no-summary-ancestor").when(F.col("evidence").isNull(), "no-adjacent-amount").when(F.coalesce("n_rows", F.lit(0)) < PRICED_ROWS, "single-item-cart").otherwise("flagged")
    return out.select("page_id", "node_id", "pre", "end", "evidence", outcome.alias("outcome"))


def priced_rows(n: DataFrame, e: DataFrame, boxes: DataFrame) -> DataFrame:
    """page_id, node_id and n_rows of containers (page_id, node_id, pre, end): rows with a price that are no totals. The row of
    an amount that stands alone is the nearest element around it in which something else is said."""
    text = F.regexp_replace("text_content", r"\s+", " ")
    alone = _money_alone(text)
    leaf = e.filter((F.col("n_children") == 0) & F.col("text_len").between(1, ROW_CAP) & text.rlike(MONEY)).withColumn("_alone", alone)
    # A child is part of a row if its parent has another child that says something and is no amount.
    says = (F.col("text_len") > 0) & ~((F.col("text_len") < ROW_CAP) & alone)
    w = Window.partitionBy("page_id", "parent_id")
    part = e.withColumn("_says", says.cast("int")).withColumn("_others", F.sum("_says").over(w) - F.col("_says")).filter("_others > 0 AND parent_id IS NOT NULL").select("page_id", "pre", "end", "parent_id")
    held = D.nearest(leaf.select("page_id", "node_id", "pre", "end", "_alone"), part, "_row", F.col("parent_id"))
    row = F.when(F.col("_alone"), F.col("_row")).otherwise(F.col("node_id"))
    rows = held.select("page_id", row.alias("node_id"), F.col("node_id").alias("_leaf"), F.col("pre").alias("_at")).filter("node_id IS NOT NULL").join(e.select("page_id", "node_id", "pre", "end"), ["page_id", "node_id"])
    b = boxes.select(F.col("page_id").alias("_p"), F.col("node_id").alias("_box"), F.col("pre").alias("_b"), F.col("end").alias("_e"))
    within = rows.join(b, (F.col("page_id") == F.col("_p")) & (F.col("pre") > F.col("_b")) & (F.col("pre") <= F.col("_e"))).select("page_id", "_box", "node_id", "pre", "end").distinct()
    said = D.whole_text(n, within.select("page_id", "node_id", "pre", "end").distinct())
    good = within.join(said, ["page_id", "node_id"]).filter(~F.lower(F.regexp_replace("said", r"\s+", " ")).rlike(TOTAL))
    return good.groupBy("page_id", F.col("_box").alias("node_id")).agg(F.count(F.lit(1)).alias("n_rows"))


def hidden_fees(n: DataFrame) -> DataFrame:
    """Fees in the summary of an order of several rows, with their amount."""
    return fee_outcomes(n).filter("outcome = 'flagged'").drop("outcome")


#: Names of fields whose default is a guess at the place or the language, not a choice made for the user.
PLACES = "country|state|province|region|city|county|locale|lang|currency|time.?zone"


def form_prefill(n: DataFrame) -> DataFrame:
    """Filled inputs without an autofill token, selects whose default is not the first option, and pre-checked radios, one for each
    group; at most eight in a form."""
    c = n.filter(U.is_checkout(F.col("url")) & F.col("in_form"))
    free = D.attr("disabled").isNull() & D.attr("readonly").isNull()
    kind, name = F.coalesce(F.lower(D.attr("type")), F.lit("text")), F.coalesce(D.attr("name"), F.lit(""))
    filled = _element("input") & kind.rlike(f"^(?:{FORMS})$") & (F.coalesce(D.attr("value"), F.lit("")) != "") & ~F.coalesce(D.attr("autocomplete"), F.lit("")).rlike("name|email|tel|address|postal|country|cc-")
    text = _found(c, filled & free, F.concat(kind, F.lit(":"), name))
    forms = n.filter(_element("form") & U.is_checkout(F.col("url"))).select("page_id", "node_id", "pre", "end")
    radio = D.closest(_found(c, _element("input") & (kind == "radio") & D.attr("checked").isNotNull() & free, F.concat(kind, F.lit(":"), name)), forms)
    first = Window.partitionBy("page_id", "holder_id", "evidence").orderBy("pre")
    radio = radio.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "holder_id")
    selects = c.filter(_element("select") & free & ~F.lower(F.concat(name, F.lit(" "), F.coalesce(D.attr("id"), F.lit("")))).rlike(PLACES)).select("page_id", "node_id", "pre", "end", F.concat(F.lit("select:"), name).alias("evidence"))
    options = D.closest(c.filter(_element("option")).select("page_id", "node_id", "pre", "end", D.attr("selected").isNotNull().alias("_on")), selects).filter("holder_id IS NOT NULL")
    chosen = options.groupBy("page_id", F.col("holder_id").alias("node_id")).agg(F.min("pre").alias("_first"), F.min(F.when(F.col("_on"), F.col("pre"))).alias("_at")).filter("_at > _first").select("page_id", "node_id")
    held = D.closest(text.unionByName(radio).unionByName(selects.join(chosen, ["page_id", "node_id"], "left_semi")), forms)
    w = Window.partitionBy("page_id", "holder_id").orderBy("pre")
    return held.withColumn("_n", F.row_number().over(w)).filter("_n <= 8").select("page_id", "node_id", "pre", "end", "evidence")


@local()
def hidden_affiliate():
    name = F.lower(D.attr("name"))
    hit = name.rlike("^(?:utm_.*|aff(?:iliate)?(?:_?id)?|ref(?:erral|errer)?(?:_?(?:id|code))?|gclid|fbclid|msclkid|click_?id|partner_?id|subid)$") & ~name.rlike("csrf|token|nonce|session")
    outcome = F.when(F.coalesce(D.attr("value"), F.lit("")) == "", "already-empty").otherwise("cleared")
    return F.coalesce(F.when(_element("input") & (D.attr("type") == "hidden") & F.col("in_form"), hit & U.is_checkout(F.col("url"))), F.lit(False)), F.concat(name, F.lit(":"), outcome)


def disguised_ads(n: DataFrame) -> DataFrame:
    """A small disclosure label in an article-like card with a heading and prose; the first of each card."""
    label = D.innermost(_found(n, _small(80, 3) & ~F.col("tag").isin("button", "a", "nav") & F.lower("text_content").rlike(r"^(?:sponsored|promoted|advertisement|ad|paid (?:post|partnership)|\[ad\])$|(?:^|\W)(?:sponsored|promoted)$"), F.col("text_content")), "page_id")
    cards = n.filter(_element("article", "li", "div", "section") & (F.col("text_len") >= 80))
    heads = n.filter(_element("h1", "h2", "h3", "h4"))
    cards = cards.join(heads.select(F.col("page_id").alias("_p"), F.col("pre").alias("_h")), (F.col("page_id") == F.col("_p")) & (F.col("_h") > F.col("pre")) & (F.col("_h") <= F.col("end")), "left_semi")
    held = D.closest(label, cards).filter("holder_id IS NOT NULL")
    w = Window.partitionBy("page_id", "holder_id").orderBy("pre")
    return held.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("page_id", "node_id", "pre", "end", "evidence")


def svg_sprites(n: DataFrame) -> DataFrame:
    """Hidden svg elements that hold symbols none of which the page uses."""
    used = n.filter(_element("use")).select(F.col("page_id").alias("_p"), F.regexp_replace(F.coalesce(D.attr("href"), D.attr("xlink:href")), "^#", "").alias("_u"))
    symbols = n.filter(_element("symbol")).select("page_id", F.col("pre").alias("_s"), D.attr("id").alias("_id"))
    live = symbols.join(used, (F.col("page_id") == F.col("_p")) & (F.col("_id") == F.col("_u")), "left_semi").select(F.col("page_id").alias("_q"), "_s")
    every = symbols.select(F.col("page_id").alias("_q"), "_s")
    within = (F.col("page_id") == F.col("_q")) & (F.col("_s") > F.col("pre")) & (F.col("_s") <= F.col("end"))
    svg = _found(styled(n), _element("svg") & F.coalesce((style("display") == "none") | (D.attr("hidden").isNotNull()) | (D.attr("aria-hidden") == "true"), F.lit(False)), "sprite")
    return svg.join(every, within, "left_semi").join(live, within, "left_anti")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    group: str
    default_on: bool
    run: Callable[[DataFrame], DataFrame] | None
    top_frame_only: bool = False
    approximate: bool = False

    @property
    def verb(self) -> str:
        return self.rule_id.rpartition("-")[2]


#: The catalog in order of evaluation. Rules without ``run`` need the URL alone or a model, and live elsewhere.
RULES = [
    Rule("pii-redact", "sensitive", True, personal_data), Rule("secrets-redact", "sensitive", True, secrets), Rule("reviews-redact", "injection", True, _selected(REVIEWS, "reviews")), Rule("comments-redact", "injection", True, _selected(COMMENTS, "comments")),
    Rule("prompt-injection-redact", "injection", True, lambda n: D.outermost(prompt_injection(n), "page_id")), Rule("countdown-timer-redact", "dark patterns", True, timers), Rule("scarcity-redact", "dark patterns", True, scarcity), Rule("confirmshame-sanitize", "dark patterns", True, confirmshame),
    Rule("footer-redact", "pollution", True, footer, True), Rule("checkout-checkbox-sanitize", "dark patterns", True, checkout_boxes), Rule("cookie-banner-hide", "pollution", True, _selected(COOKIES, "cookies"), True), Rule("chat-widget-hide", "pollution", True, _selected(CHAT, "chat"), True),
    Rule("html-comment-strip", "injection", True, comments_injected), Rule("hidden-text-strip", "injection", True, hidden_text, approximate=True), Rule("unicode-invisibles-strip", "injection", True, invisible), Rule("noscript-strip", "injection", True, noscript),
    Rule("json-ld-sanitize", "injection", True, json_ld), Rule("meta-injection-strip", "injection", True, meta_injected), Rule("attribute-injection-sanitize", "injection", True, attributes_injected), Rule("newsletter-modal-hide", "dark patterns", True, newsletter, True, True),
    Rule("svg-sprite-strip", "pollution", True, svg_sprites), Rule("svg-text-strip", "injection", True, svg_text), Rule("social-embed-redact", "injection", True, _selected(SOCIAL, "social", SOCIAL_HOSTS)), Rule("ads-hide", "pollution", True, _selected(ADS, "ad")),
    Rule("cart-addon-annotate", "dark patterns", True, cart_addons), Rule("link-spoof-annotate", "injection", True, link_spoof), Rule("trust-badge-annotate", "injection", False, trust_badges), Rule("search-url-helper", "shortcuts", True, None, True),
    Rule("roach-motel-annotate", "dark patterns", True, None, True), Rule("irrelevant-sections-redact", "pollution", False, None, True), Rule("cross-origin-frame-redact", "injection", False, cross_origin_frames), Rule("schema-trust-sanitize", "injection", False, schema_trust),
    Rule("disguised-ad-flag", "pollution", True, disguised_ads), Rule("encoded-payload-redact", "sensitive", True, encoded), Rule("webdriver-probe-annotate", "injection", False, webdriver_probe, True, True), Rule("closed-shadow-root-annotate", "injection", False, closed_shadow, True, True),
    Rule("hidden-fee-annotate", "dark patterns", True, hidden_fees), Rule("form-prefill-annotate", "dark patterns", True, form_prefill), Rule("hidden-affiliate-sanitize", "dark patterns", True, hidden_affiliate),
]


def local_hits(nodes: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """rule_id, post and evidence of what ``rules``, all of one node each, say of single nodes, with the columns ``keep``: one
    array for each node."""
    hits = []
    for r in rules:
        where, e = r.run.hit()
        hits.append(F.when(where, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.run.post).alias("post"), (F.lit(e) if isinstance(e, str) else e).cast("string").alias("evidence"))))
    # A column of its own is compiled; an array within ``explode`` is not, and is made once more to see whether it is empty.
    told = nodes.select(*keep, F.array_compact(F.array(*hits)).alias("_hits"))
    return told.select(*keep, F.explode_outer("_hits").alias("h")).filter("h IS NOT NULL").select(*keep, "h.*")


def settled(each: DataFrame) -> DataFrame:
    """Of local hits (page_id, rule_id, pre, end, post) the outermost, the innermost or all, as their rule asks."""
    w = Window.partitionBy("page_id", "rule_id").orderBy("pre")
    reach, follows = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("pre").over(w)
    each = each.withColumns({"_reach": reach, "_next": follows})
    kept = F.when(F.col("post") == "outermost", F.col("_reach").isNull() | (F.col("_reach") < F.col("pre"))).when(F.col("post") == "innermost", F.col("_next").isNull() | (F.col("_next") > F.col("end"))).otherwise(True)
    return each.filter(kept).drop("_reach", "_next")


def detect(nodes: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, rule_id, node_id, evidence of all given rules (all that are on by default).

    Rules that look at one node are told by one array for each node; a plan reads the nodes once for all of them, and
    once more for each other rule.
    """
    chosen = [r for r in (RULES if rules is None else rules) if r.run and (rules is not None or r.default_on)]
    one = [r for r in chosen if isinstance(r.run, Local)]
    parts = [r.run(nodes).select("page_id", F.lit(r.rule_id).alias("rule_id"), "node_id", "evidence") for r in chosen if r not in one]
    if one:
        parts.append(settled(local_hits(nodes, one, "page_id", "node_id", "pre", "end")).select("page_id", "rule_id", "node_id", "evidence"))
    return reduce(DataFrame.unionByName, parts)
