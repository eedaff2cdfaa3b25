"""The page parser on odd markup, and extraction quality on hand-labelled pages of layouts the training never wrote."""

import random
import time

import pytest

from anchorframe.llm import htmltext as ht


def leaves(page):
    return [n.text for n in ht._order(ht.parse(page)) if n.tag == "#text"]


def test_probe_cases():
    assert leaves('<p data-truth="yes">x</p>') == ["x"] and leaves("<p data-truth='1'>x</p>") == ["x"]
    assert leaves("<p title=it's>Hello world, first.</p><p>It's fine, second.</p><p>Third.</p>") == ["Hello world, first.", "It's fine, second.", "Third."]
    assert leaves("<svg class=i /><p>First.</p><p>Second.</p><svg><text>no</text></svg><p>Third.</p>") == ["First.", "Second.", "Third."]
    assert leaves("<svg class=i/><p>in</p></svg><p>out</p>") == ["out"]  # the slash belongs to the value
    assert leaves("<svg><svg/><svg>a</svg>b</svg>c") == ["c"]
    assert leaves('<a href="x>one<p>two</p>') == ["one", "two"]  # a quote that never ends
    assert leaves("a < b<p>c&lt;d &#233;&eacute;</p><!-- x <p>no</p> --><!-->e<!--->f") == ["a < b", "c<d éé", "ef"]
    assert leaves("<p>a<br>b<p>c<hr>d</p>e</p>f") == ["a b", "c", "d", "e", "f"]
    assert leaves("<select><option>x<p>kept: never closed") == ["x", "kept: never closed"]
    assert leaves("one<script>var a='<p>no</p>'</SCRIPT >two<style>p{}") == ["onetwo"]
    assert leaves("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</div>4</table>") == ["a", "b", "c", "d", "1", "2", "3", "4"]
    assert leaves("</><p>x</ ignored>y<? no ?>z<!doctype no>") == ["xyz"]
    assert leaves("") == [] and leaves("plain text") == ["plain text"] and leaves("x <a ") == ["x"]


@pytest.mark.parametrize(
    "bad",
    ["<a ", '<a b="', "<a b='", "<", "</", "<!--", "<!", "<select>", "<svg>", "<b>", "<div>", "<li>", "<p>", "</div>", "<template><select>", "<script>", "<div><li></li>", "&", "<td></p>", "<a =", "<ul><div><li>"],
)
def test_time_grows_with_the_length_only(bad):
    def took(n):
        began = time.perf_counter()
        ht.features(ht.parse("<p>x</p>" + bad * n + "<p>end</p>"))
        return time.perf_counter() - began

    took(500)
    assert took(40_000) < 40 * max(took(4_000), 0.02)


def test_visible_text_of_random_pages():
    r = random.Random(11)

    def words():
        return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 8)))

    def attrs():
        value = lambda: r.choice(['"a > b"', "'it is \" <b>'", "it's", "a/b", '""', "x\"y"])
        return "".join(f" {r.choice(['class', 'title', 'DATA-x', 'data-truth', '/', 'hidden'])}{r.choice(['=', ' = ', '']) and '=' + value()}" for _ in range(r.choice([0, 0, 1, 3])))

    def noise():
        return r.choice(["", "", "<!-- <p>no -->", "<script>if (a<b) '<p>no</p>'</script>", "<svg><path/><text>no</text></svg>", "<svg />", "<img src=x>", "<select><option>no</select>", "<style>a>b{}</style>", "<wbr>", "<math><mi>no</mi></math>"])

    def inline(depth=0):
        t = words()
        if depth > 2 or r.random() < 0.4:
            return t, t
        a, x = inline(depth + 1)
        tag = r.choice(["b", "i", "span", "a", "EM", "custom-x"])
        s = words()
        return f"{s} <{tag}{attrs()}>{a}</{tag}>{noise()} {t}", f"{s} {x} {t}"

    for _ in range(300):
        page, want, opened = [], [], []
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.3:
                opened.append(r.choice(["div", "section", "ARTICLE", "main", "blockquote"]))
                page.append(f"<{opened[-1]}{attrs()}>")
            if opened and r.random() < 0.2:
                page.append(f"</{opened.pop()}>")
            a, x = inline()
            tag = r.choice(["p", "h2", "div", "P"])
            page.append(f"{noise()}<{tag}{attrs()}>\n {a} \t" + ("" if tag.lower() == "p" and r.random() < 0.5 else f"</{tag}>"))
            want.append(x)
            if page[-1].endswith("\t"):
                page.append("<div></div>")
        assert leaves("".join(page)) == want


K, X = "keep", "drop"

#: Pages in layouts of their own; blocks that start with "+" are main text, those with "-" are not.
FOREIGN = [
    """<body><div id=masthead><a href=/>-The Daily Harbour</a><div class=tagline>-News since 1901</div></div><div class=menu><a href=/a>-World</a> <a href=/b>Sport</a> <a href=/c>Culture</a></div>
    <div class="story-body"><h1>+Ferry service returns to the bay after nine years</h1><p class=byline>+By our correspondent in the north.</p><p>+The first ferry left the old pier on Monday morning, with some two hundred passengers aboard, most of them schoolchildren who had never crossed the bay by boat.</p>
    <div class="ad-slot">-Save on car insurance today!</div><p>+Its captain, who learned the route from her father, said the currents had not changed, but that the lights along the shore were now far brighter.</p><blockquote>+We waited a long time for this, and the sea waited with us.</blockquote><ul><li>+Three crossings a day, in both directions.</li><li>+Bicycles travel free of charge on weekdays.</li></ul></div>
    <div class=related-links><h3>-More on this</h3><ul><li><a href=1>-Harbour dues to rise</a></li><li><a href=2>-Old pier listed</a></li></ul></div><div class=bottom-bar>-All rights reserved. Printed in the harbour.</div></body>""",
    """<div class=wrap><header role=banner><nav><ul><li><a href=#>-Home</a><li><a href=#>-Recipes</a><li><a href=#>-About</a></ul></nav></header><main><article><header><h1>+Lentil soup with lemon</h1></header>
    <p>+Rinse the lentils, then simmer them with bay and garlic until they are soft, which takes about forty minutes on a low flame.</p><h2>+What you need</h2><ol><li>+Two cups of red lentils</li><li>+One lemon, cut in half</li></ol><p>+Serve hot.</p></article>
    <section id=comments><h2>-12 comments</h2><ol><li><p>-Lovely, made it twice this week and the kids asked for more, thank you so much for sharing it.</p></li><li><p>-Mine burned.</p></li></ol><form action=/c><textarea>-x</textarea><label>-Your name</label><button>Send</button></form></section></main>
    <aside class=widget><h3>-Newsletter</h3><p>-Get a recipe each Friday, straight to your inbox.</p></aside><footer><p>-Written in a small kitchen. Contact us.</p></footer></div>""",
    """<html><body><table class=layout><tr><td class=leftnav><a href=a>-Index</a><br><a href=b>Archive</a><br><a href=c>Links</a></td><td class=content><h2>+On the migration of storks</h2><p>+In spring the storks come back along the river valley, flying by day and resting on the church towers of the plain.</p>
    <p>+Rings on their legs have shown that single birds return to the same nest for more than ten years.</p><table><tr><td>+Year</td><td>+Pairs counted</td></tr><tr><td>+1998</td><td>+41</td></tr></table></td></tr></table><div class=footer>-Page maintained by the bird club, last changed in May.</div></body></html>""",
    """<div class="cookie-banner"><p>-We use cookies to improve your visit. Read our policy, or accept all of them at once.</p></div><div id=app><div class=topbar><span>-Logo</span></div><div class=page><div class="post"><div class=post-title>+A slow walk through the old quarter</div><div class=post-content>+The gate stands open, though nobody seems to guard it, and the street behind it bends twice before the square comes into view.
    <br><br>Beyond the square there is a garden.<div class=share-buttons><a href=t>-Tweet</a> <a href=f>Post</a></div><p>+In the garden grow quinces, medlars, and a fig tree said to be older than the wall it leans on.</p></div></div><div class=sidebar><h4>-Popular</h4><p><a href=1>-Ten cafes</a></p><p><a href=2>-Night trains</a></p></div></div></div>""",
    """<html><body><section class=hero><h1>+How tides are predicted</h1></section><section><p>+Each harbour has its own table of constants, found from long records of the water level, and from them the height for any hour can be summed.</p><figure><img src=x><figcaption>+A tide gauge in the outer harbour.</figcaption></figure><p>+The sum has some forty terms. Most are small.</p></section>
    <section class=subscribe-box><p>-Subscribe for more articles like this one, no spam, ever.</p><form><input></form></section><footer class=site-footer><ul><li><a href=i>-Imprint</a></li><li><a href=p>-Privacy</a></li></ul></footer></body></html>""",
    """<body><ul class=breadcrumb><li><a href=/>-Home</a></li><li><a href=/n>-Notes</a></li></ul><h1>+Repairing a bicycle wheel</h1><p>+First take off the tyre, and mark the spoke that is loose with a piece of tape so you can find it again when the wheel turns.</p><p>+Then tighten it by a quarter turn at a time.</p><div class=promo><p>-Our shop sells spokes of every length, order now.</p></div><p>+Check that the rim runs true.</p>
    <div id=disqus><div class=comment>-Great guide, helped me a lot with my old racer, cheers from the south coast.</div></div><p class=copyright>-Copyright by the workshop.</p></body>""",
]


def measure(pages):
    """Block precision and recall, and the share of pages that are wholly right."""
    hit = got = true = whole = 0
    for page in pages:
        blocks = [n.text for n in ht._order(ht.parse(page)) if n.tag == "#text"]
        out = ht.texts([page], ht.model())[0].split("\n")
        want = [b for b in blocks if b.startswith("+")]
        kept = [b for b in out if b]
        hit += sum(b in want for b in kept)
        got, true, whole = got + len(kept), true + len(want), whole + (kept == want)
    return hit / max(got, 1), hit / true, whole / len(pages)


def test_foreign_layouts():
    precision, recall, whole = measure(FOREIGN)
    print(f"precision {precision:.3f} recall {recall:.3f} whole pages {whole:.2f}")
    assert precision >= 0.9 and recall >= 0.9


def test_attribute_tokens_are_learned():
    m = ht.model().meaning
    known = [m[ht.bucket(t)] for t in ("sidebar", "cookie", "comments", "advert")]
    assert max(known) < 0 < min(m[ht.bucket(t)] for t in ("article", "story", "content"))
    assert (m != 0).sum() < ht.BUCKETS / 2
