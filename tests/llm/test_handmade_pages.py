"""Pages labelled by hand, in styles that the generator of training pages does not have."""

import pytest

from lectern.llm import html_extract
from lectern.llm.html_pages import labelled_pages

NEWS = """<!doctype html><html lang=en><body class="home single-view"><div id="skip-link"><a href="#c">Skip to content</a></div>
<div class="site-top"><div class="logo"><a href="/">The Harbour Gazette</a></div><ul class="primary-menu"><li><a href=/a>Politics</a><li><a href=/b>Sport</a><li><a href=/c>Weather</a></ul></div>
<div class="page-wrap"><div class="story-body" itemprop="articleBody"><h1>Ferry returns after a winter of repairs</h1>
<p class="lede">The <em>Morning Star</em> left the quay on Tuesday, eleven weeks later than planned.</p>
<div class="ad-slot ad-slot--inline"><p>Advertisement: new boots at half the price</p></div>
<p>Its captain, who has sailed the route for thirty years, said the new engine was &ldquo;quieter than a cat&rdquo;.</p>
<blockquote>We waited for every part.</blockquote><p>Timetables are posted at the harbour office.</p></div>
<div class="rail"><h3>Most read</h3><ol><li><a href=/1>Lost dog found</a><li><a href=/2>Bridge closed</a></ol></div></div>
<div class="footer-links"><a href=/t>Terms</a> <a href=/p>Privacy</a> &copy; 2024 Harbour Media</div></body></html>"""
NEWS_TEXT = (
    "Ferry returns after a winter of repairs The Morning Star left the quay on Tuesday, eleven weeks later than planned. Its captain, who has sailed the "
    "route for thirty years, said the new engine was “quieter than a cat”. We waited for every part. Timetables are posted at the harbour office."
)
BLOG = """<html><body><header role=banner><h2><a href=/>Notes on bread</a></h2></header><nav role=navigation><a href=/x>About</a><a href=/y>Archive</a></nav>
<main><article class="h-entry"><h1 class="p-name">A slow rye loaf</h1><p>Mix the flour and the water the evening before.</p><ul><li>400 g rye flour</li><li>350 g water</li></ul>
<p>Bake it for an hour.</p><form action=/s><label>Your mail <input name=m></label><button>Subscribe</button></form></article>
<section id="comments"><h3>Two replies</h3><div class="comment"><p>Mine came out flat, what did I do wrong?</p></div><div class="comment"><p>Less water, I think.</p></div></section></main>
<footer><p>Powered by flour.</p></footer></body></html>"""
BLOG_TEXT = "A slow rye loaf Mix the flour and the water the evening before. 400 g rye flour 350 g water Bake it for an hour."
MANUAL = """<html><body><div class="navbar"><a href=1>Guide</a><a href=2>Reference</a></div><div class="toc"><ul><li><a href=#1>Install</a><li><a href=#2>Use</a></ul></div>
<div class="main-content"><h1>Installing the pump</h1><p>Close the valve first, then loosen the four bolts.</p><table><tr><th>Bolt</th><td>M8</td></tr></table>
<pre>torque = 12 Nm</pre><p>Run the pump for a minute.</p></div><div id="cookie-banner"><p>This site uses cookies.</p><button>Accept</button></div></body></html>"""
MANUAL_TEXT = "Installing the pump Close the valve first, then loosen the four bolts. Bolt M8 torque = 12 Nm Run the pump for a minute."
OLD = """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD><A HREF=a.htm>Home</A><BR><A HREF=b.htm>Pictures</A><BR><A HREF=c.htm>Guestbook</A></TD>
<TD><H1>Our trip to the lake</H1><P>We set out early in the morning and reached the lake before noon, when the sun was already high.
<P>The children swam while we put up the tents, and in the evening there was soup and singing until late.</TD></TR></TABLE></BODY></HTML>"""
OLD_TEXT = (
    "Our trip to the lake We set out early in the morning and reached the lake before noon, when the sun was already high. "
    "The children swam while we put up the tents, and in the evening there was soup and singing until late."
)


@pytest.fixture(scope="module")
def extractor():
    return html_extract.train(labelled_pages())


def score(got, want):
    """Share of the words of both that are common, in order of occurrence."""
    from difflib import SequenceMatcher

    a, b = got.split(), want.split()
    same = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return 2 * same / max(1, len(a) + len(b))


@pytest.mark.parametrize("source, text", [(NEWS, NEWS_TEXT), (BLOG, BLOG_TEXT), (MANUAL, MANUAL_TEXT), (OLD, OLD_TEXT)])
def test_other_styles(extractor, source, text):
    got = html_extract.extract(extractor, [source])[0]
    assert score(got, text) >= 0.9, got
