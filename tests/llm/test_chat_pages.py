import hashlib
import html
import re
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from fieldloom.llm import chat, rendering

NASTY = st.text(alphabet="<|\\>ab\nim_startend é😀", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_rendering_reads_back(turns):
    formatted, spans = chat.render(turns, learned=[r for r, _ in turns])
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    assert formatted.count("<|") == 2 * len(turns)


@pytest.fixture(scope="module")
def tokenizer():
    with open(chat.TOKENIZER, "rb") as f:
        return chat.load(f.read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), NASTY), max_size=6))
def test_mask_covers_the_learned_text_once(tokenizer, turns):
    row = chat.encode(tokenizer, [{"role": r, "text": t} for r, t in turns], ("assistant",))
    spans = list(zip(row["span_start"], row["span_end"]))
    for s, e, on in zip(row["token_start"], row["token_end"], row["loss_mask"]):  # by comparing all pairs
        assert on == any(max(s, a) < min(e, b) for a, b in spans)
    got = chat.masked_text(row["formatted"], row["token_start"], row["token_end"], row["loss_mask"], spans)
    assert got == [t for r, t in turns if r == "assistant"]


TURNS = "conv_id long, turn long, role string, text string, conv string, turns int, formatted int"


def test_conversations_with_odd_rows(spark):
    rows = [
        (1, 1, "assistant", "second", None, 1, 1), (1, 0, "user", None, None, 1, 1), (2, None, None, "x", None, 1, 1),
        (None, 0, "assistant", "no id", None, 1, 1), (3, 0, "assistant", "same", None, 1, 1), (3, 0, "assistant", "same", None, 1, 1),
        (4, 0, "assistant", "long 😀 " * 40_000, None, 1, 1),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.digest_conversations(df).collect()}
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = {1: [("user", ""), ("assistant", "second")], 2: [("", "x")], None: [("assistant", "no id")], 3: [("assistant", "same")] * 2}
    for i, turns in want.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[i].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[i].loss_sha256, got[i].loss_chars) == (hashlib.sha256(said.encode()).hexdigest(), len(said))
        assert chat.parse(out[i].formatted) == turns and len(out[i].loss_mask) == len(out[i].input_ids)
    assert got[4].loss_chars == len(rows[-1][3]) and got[3].n_turns == 2
    assert chat.digest_conversations(spark.createDataFrame([], TURNS)).collect() == []


GOLDEN = [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<table><tr><td>x<td>yy<tr><td>long cell<td>z</table>after", "x          yy\nlong cell  z\n\nafter"),
    ("<p>a<p>b<div hidden>no</div>c<br>d<pre> x\n  y</pre>", "a\n\nb\n\nc\nd\n\n x\n  y"),
    ("<ol start=3><li>a<li><p>b<p>c</ol>", "3. a\n4. b\n\n   c"),
    ("<b>x</b> y<span style='color:red; display: none'>q</span>z &amp; &nbsp;w", "x yz &  w"),
    ("<dl><dt>t<dd>d</dl><blockquote>q<p>r</blockquote>", "t\n  d\n\n  q\n\n  r"),
    ("<table><tr><td rowspan=2>A<td>B</tr><tr><td>C</tr><tr><td colspan=2>wide thing<td>D</table>", "A  B\n   C\nwide thing  D"),
    ("<details><summary>s</summary>h</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- no --><noscript>no</noscript><template>no</template>yes", "yes"),
    ("<h1>One<h2>Two</h1>three", "One\n\nTwo\n\nthree"),
    ("<table><caption>C</caption><thead><tr><th>h<th>i</thead><tbody><tr><td>1<td>2</table>", "C\nh  i\n1  2"),
    ("<p style='visibility:hidden'>no</p><input type=submit value=Go> <textarea>a\n b</textarea>", "Go\na\n b"),
    ("", ""), ("plain < text > &lt;b&gt;", "plain < text > <b>"), ("<td>loose</td><li>item", "loose\n- item"),
]


@pytest.mark.parametrize("page, text", GOLDEN)
def test_layout(page, text):
    assert rendering.render(page)[1] == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <li> <ul> </ul> <table> </table> <tr> <td> </td> <b> </b> <br> w x y".split()), max_size=40))
def test_no_visible_word_is_lost_or_moved_out(tokens):
    got = rendering.render(" ".join(tokens))[1]
    assert sorted(w for w in got.split() if w != "-") == sorted(t for t in tokens if not t.startswith("<"))


def test_deep_nesting_and_long_pages():
    assert rendering.render("<div>" * 50_000 + "deep" + "</div>" * 9)[1] == "deep"
    assert rendering.render("<table><tr><td>" * 400 + "deep")[1].strip() == "deep"
    assert len(rendering.render("<p>word " * 20_000)[1].split()) == 20_000


def naive(page):
    """Visible words of the plain pages in the test tables, by regular expressions."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(script|style|head|noscript|template|title)\b.*?</\1\s*>", "", page)
    return "".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", page)).split())


def test_pages_of_the_table_and_odd_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r.page_id: r for r in rendering.extract(pages).collect()}
    for r in pages.collect():
        assert naive(r.html or "") == "".join(w for w in out[r.page_id].text.split() if w != "-")
    df = spark.createDataFrame([(1, None, "a"), (None, "<title> T </title>", "b"), (1, None, "a")], "page_id long, html string, text string")
    got = rendering.extract(df).collect()
    assert sorted(((r.page_id, r.title, r.text, r.n_chars, r.n_lines) for r in got), key=repr) == [(1, "", "", 0, 0)] * 2 + [(None, "T", "", 0, 0)]
    assert rendering.extract(df.where("false")).collect() == []


@pytest.mark.parametrize("depth", [1, 149, 151, 160, 700, 5000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    inner = '<script>var hid=1</script><p style="display:none">secret</p><div hidden><b>more</b></div><p>seen</p>'
    assert rendering.render("<div>" * depth + inner + "</div>" * depth + "<p>after</p>")[1] == "seen\n\nafter"
    assert rendering.render("<b>" * depth + inner)[1] == "seen"
    depth = min(depth, 1500)
    nested = rendering.render("<ul><li>x" * depth + inner)[1].split("\n")
    assert sum(s.lstrip("- ") == "x" for s in nested) == depth and nested[-1].strip() == "seen"
    assert max(map(len, nested)) <= rendering.MOST_INDENT + 20


def test_digest_counts_turns_that_are_read_back():
    row = chat.encode(chat.load(open(chat.TOKENIZER, "rb").read()), [{"role": "user", "text": "a"}, {"role": "assistant", "text": "<|im_end|>"}], ("assistant",))
    assert chat.digest(row | {"n_turns": 99})["n_turns"] == 2
