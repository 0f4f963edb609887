import hashlib
import html as entities
import io
import random
import re
import zipfile

import pytest

from tamis.llm import archives, domtext
from tamis.llm.common import read

SF = "/root/testdata/sf0.001"


def test_main_text_equals_the_article_of_every_page(spark):
    def article(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1|ul|li)\b[^>]*>", "\n", body))).split())

    pages = {r["page_id"]: r["html"] for r in read(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in domtext.extract(read(spark, SF, "pages")).collect()}
    assert got == {k: article(v) for k, v in pages.items()}


@pytest.fixture(scope="module")
def learnt(spark):
    return domtext.train(read(spark, SF, "pages"))


@pytest.mark.parametrize("page, text", [
    ("<body><header>Site</header><main><h1>T</h1><p>a <b>b</b>c &amp; d<div class='ad'>buy</div><p>e<br>f<form>x</form>"
     "<section id=comments><p>great</p><p>post</p><p>really</p></section></main><aside>s</aside><footer>f</footer>", "T a bc & d e f"),
    ("<div class='page with-header'><article class='post has-comments'><p>Good text</p><div class=related><p>a<p>b<p>c</div></article>"
     "<div id=comments><article class=comment><p>c1</p></article></div></div>", "Good text"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><article><p>y&eacute;s</p><!-- no --><p>  more\n text ", "yés more text"),
    ("<article><p>One two. Three four.</p><p class='contact-lens'>Five six. Seven eight.</p></article>", "One two. Three four. Five six. Seven eight."),
    ("<body><div class='story-share-wrap'><p>One two. Three four.</p></div></body>", "One two. Three four."),
    ("<article><p>Good text.</p></article><div id='comments'>" + "<p>They say this. And that too.</p>" * 40 + "</div>", "Good text."),
    ("<article><p>Good text.</p><div class='share-buttons'><a href=x>one</a> <a href=y>two</a></div></article>", "Good text."),
    ("<nav><p>menu</p></nav>", ""), ("", ""), (None, ""), ("<article></article>", ""), ("<article>x<<y & z</article", None),
])
def test_main_text_of_odd_pages(learnt, page, text):
    for model in (domtext.model_from({}), learnt):
        assert text is None or domtext.main_text(page, model) == text


def templated(rng, tag):
    """A page of a site whose classes are codes, with its main text; ``tag`` is the element that holds it."""
    words = "time year way day thing world school group country problem hand part place week company point night".split()

    def prose(n):
        return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 16))).capitalize() + "." for _ in range(n))

    title, body = prose(1), [prose(rng.randint(2, 5)) for _ in range(rng.randint(2, 6))]
    menu = " ".join(f"<a href='/{k}'>{rng.choice(words)}</a>" for k in range(6))
    return (
        f"<body><div class='z2'>{menu}</div><div class='z3'><p>{prose(1)}</p></div>"
        f"<{tag} class='z4'><h1>{title}</h1>" + "".join(f"<p class='z1'>{p}</p>" for p in body) + f"</{tag}>"
        f"<div class='z7'><p>{prose(3)}</p><p>{prose(3)}</p></div>" + f"<div class='z5'><div class='z6'><p>{prose(1)}</p></div></div></body>"
    ), " ".join([title, *body])


def test_training_finds_the_text_where_neither_tags_nor_words_tell(spark):
    """Fitted on pages with an article tag, held out on pages without one: what is learnt decides, not the lexicon."""
    rng = random.Random(5)
    pages = [(k, "u", templated(rng, "article")[0]) for k in range(300)]
    model = domtext.train(table(spark, pages))
    held = [templated(rng, "div") for _ in range(100)]
    assert sum(domtext.main_text(page, model) == text for page, text in held) >= 95
    assert sum(domtext.main_text(page, domtext.model_from({})) == text for page, text in held) == 0


def test_labels_of_pages_come_from_tags_alone():
    tree = domtext.parsed("<div class=post><p>a</p></div><article><p>b</p><div class=ad>c</div><p class='sidebar-x'>d</p><footer>e</footer></article>")
    labels = {(node.tag, *node.whole): label for node, label in zip(tree.nodes, domtext.marked_content(tree))}
    assert labels["div", "post"] == 0 and labels["article",] == 1 and labels["footer",] == 0
    assert labels["div", "ad"] is None and labels["p", "sidebar-x"] is None  # not told by a tag, so not learnt from


def test_marginals_equal_enumeration():
    import itertools
    import math

    tree = domtext.parsed("<article><p>abc</p><div class=ad><a href=x>d</a></div></article>")
    model = domtext.model_from({
        ("tag:p", 1): 5, ("tag:a", 0): 3, ("nodes", 0): 10, ("nodes", 1): 10, ("edge:1", 1): 9, ("edge:0", 0): 4, ("edge:1", 0): 1,
    })
    weights = [0.0] * len(tree.nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(tree.nodes)):
        score = sum(model.potential(n)[k] for n, k in zip(tree.nodes, labels))
        score += sum(model.edge(tree.nodes[n.parent])[labels[n.parent]][k] for n, k in zip(tree.nodes, labels) if n.parent >= 0)
        total += math.exp(score)
        for at, k in enumerate(labels):
            weights[at] += k * math.exp(score)
    assert domtext.marginals(tree, model) == pytest.approx([w / total for w in weights])


def table(spark, rows):
    return spark.createDataFrame([r + (1, "x") for r in rows], "page_id long, url string, html string, keeper int, digest string")


def test_extract_of_empty_and_repeated_rows(spark):
    assert domtext.extract(table(spark, [])).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "u", "<article>a</article>")]
    assert sorted(str(tuple(r)) for r in domtext.extract(table(spark, rows)).collect()) == sorted(map(str, [(1, None, ""), (1, None, ""), (None, "u", "a")]))


def test_archives_round_trip(spark, tmp_path):
    big, twice = "é" * 600, "<p>" + "x" * 2000
    rows = [(1, "http://a/\r\nb%41", big), (2, None, big), (3, "u", twice), (9, "u", twice), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", "a\r\n\r\nb\x00"), (None, "u", twice), (10, "u", "z" * 3_000_000)]
    manifest = archives.write_archives(table(spark, rows).repartition(3), f"file://{tmp_path}/w", package_bytes_limit=2000)
    got = {r["page_id"]: r.asDict() for r in archives.read_archives(manifest).collect()}
    assert len(got) == len(rows)
    for page_id, url, text in rows:
        payload = (text or "").encode()
        same = [i for i, _, t in rows if t == text and i is not None and len(payload) >= 1000]
        keeper = max(same, default=page_id)
        record = got[page_id]
        revisit = keeper != page_id
        assert record == {
            "page_id": page_id, "url": url, "record_type": "revisit" if revisit else "response", "refers_to": keeper if revisit else None,
            "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": None if revisit else payload,
        } or record["payload"] == bytearray(payload)
    for name in tmp_path.glob("w/*.wacz"):
        assert zipfile.ZipFile(name).testzip() is None
    assert archives.write_archives(table(spark, []), f"file://{tmp_path}/e").count() == 0


def test_directories_of_any_package():
    for count, comment, wide in ((3, b"", False), (70_000, b"PK\x05\x06 not it", False), (2, b"c" * 65535, True)):
        out = io.BytesIO(b"leading bytes are not allowed here"[:0])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            for k in range(count):
                with package.open(zipfile.ZipInfo(f"m/{k}é"), "w", force_zip64=wide) as member:
                    member.write(b"%d" % k)
            package.comment = comment
        data = out.getvalue()
        fetch = lambda offset, length: data[offset : offset + length]
        found = archives.members(fetch, len(data))
        assert len(found) == count
        for k in (0, count - 1):
            method, header, length = found[f"m/{k}é"]
            start = archives.member_start(fetch, header)
            assert method == 0 and data[start : start + length] == b"%d" % k
    with pytest.raises(ValueError):
        archives.members(lambda o, n: b"x" * n, 100)


def test_deep_pages_are_read_in_linear_time():
    import time

    model = domtext.model_from({})
    for piece in ("<b>x ", "<b><p>x ", "<i>x</u> ", "<article>x ", "<li>x ", "<span>x</div><li> "):
        spent = []
        for n in (4_000, 32_000):
            started = time.perf_counter()
            text = domtext.main_text("<article>" + piece * n, model)
            spent.append(time.perf_counter() - started)
            assert text.split() == ["x"] * n
        assert spent[1] < 30 * spent[0] + 0.5, (piece, spent)  # the square would be 64 times


def test_text_of_formulas_drawings_and_objects_is_kept():
    model = domtext.model_from({})
    html = "<article><p>Let <math>x=2</math> hold, see <svg><text>figure</text></svg> or <object>its text</object>.</p><script>no</script></article>"
    assert domtext.main_text(html, model) == "Let x=2 hold, see figure or its text."


def test_lengths_are_summed_over_all_that_an_element_holds():
    tree = domtext.parsed("<div>abc<p>de <a>fgh<b>i</b></a></p></div><p>jk</p>")
    told = {node.tag: (node.text, node.linked) for node in tree.nodes[:-1]}
    assert told == {"#page": (11, 4), "div": (9, 4), "p": (6, 4), "a": (4, 4), "b": (1, 1)} and tree.nodes[-1].text == 2
