"""Archives, chats and page texts: exact round trips and odd cases."""

import hashlib
import json
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from rowpact.llm import chat, warc, wrapper

PAGES = "page_id long, url string, html string, payload string, digest string"


@pytest.fixture
def pages(llm):
    def make(rows):
        return llm.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    return make


# --- 4

HTML = "<p>é " + "x" * 100 + "</p>"
WARC_ROWS = [(5, "http://a/ä b\r\nX: y", HTML), (3, None, HTML), (9, "u", HTML), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", HTML),
             (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "z" * 300_000), (10, "u", "y" * 100), (11, "u", "y" * 100), (11, "v", "y" * 100),
             (None, "u", "only nulls" * 20), (None, "w", "only nulls" * 20)]


def brute_records(rows):
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html] = min(least.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and least.get(html) is not None and page != least[html]
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least[html] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("package_bytes", [1 << 20, 300])
def test_archives(scratch, pages, package_bytes):
    packages = warc.write(pages(WARC_ROWS), scratch, package_bytes=package_bytes)
    got = warc.read(packages).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=repr) == brute_records(WARC_ROWS)
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in {(x[2] or "").encode() for x in WARC_ROWS if x[0] == r["page_id"]}
    assert {r["url"] for r in got} >= {None, "http://a/%C3%A4%20b%0D%0AX:%20y"}
    for uri in [r["uri"] for r in packages.collect()]:
        with zipfile.ZipFile(uri.removeprefix("file:")) as package:
            assert package.testzip() is None and {x.compress_type for x in package.infolist()} == {zipfile.ZIP_STORED}


def test_archives_of_an_empty_table(scratch, pages):
    assert warc.read(warc.write(pages([]), scratch)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directories(tmp_path, monkeypatch, wide):
    """ZIP64 directories, comments and deflated members."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("deflated", "q" * 1000, zipfile.ZIP_DEFLATED)
        for k in range(4):
            package.writestr(f"päth/{k}", bytes([k]) * (k * 50))
        package.comment = b"PK\x05 comment"
    data = path.read_bytes()
    assert (b"PK\x06\x06" in data) == wide
    found = warc.members(f"file://{path}")
    assert set(found) == {f"päth/{k}" for k in range(4)}
    for k in range(4):
        start, length = found[f"päth/{k}"]
        assert data[start : start + length] == bytes([k]) * (k * 50)


def test_a_damaged_file_is_told(tmp_path):
    (tmp_path / "x").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.members(f"file://{tmp_path}/x")


# --- 5

@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\imend_star>\nab ", max_size=12), st.text("<|\\im_endstrp>\nab é", max_size=40)), max_size=5))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns, ("a",))
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "a"]


def test_masks():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 6), (6, 8), (6, 8), (8, 9)])
    assert chat.mask(offsets, np.array([[2, 6]])).tolist() == [False, True, True, True, False, False, False]
    assert chat.mask(offsets, np.array([[7, 8]])).tolist() == [False, False, False, False, True, True, False]
    assert not chat.mask(offsets, np.zeros((0, 2), int)).any() and not len(chat.mask(offsets[:0], np.array([[1, 2]])))


@pytest.mark.parametrize("run_chars", [1 << 18, 30])
def test_chats(llm, scratch, run_chars):
    rng = random.Random(1)
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (1, 2, "assistant", None), (1, 1, None, "é😀 ü"), (1, None, "assistant", "\n\n  x \n"), (None, 1, "assistant", "null id"),
            (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (3, 0, "assistant", "y" * 50_000), (4, 0, "sys\ntem", "<|endoftext|> <\\|im_sep|> <"), (4, 1, "assistant", "<")]
    rows += [(10 + k % 3, k, rng.choice(["user", "assistant", "system"]), " ".join(rng.choice(["das", "😀", "漢字", "<|", "|>", "\\", "\n"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    table = llm.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, run int")
    got = {r["conv_id"]: r for r in chat.digests(scratch.stage(chat.format_chats(table, run_chars=run_chars), "chats")).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(all_.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.digests(chat.format_chats(table.filter("turn > 9999"))).count() == 0


def test_runs_give_the_tokens_of_the_whole(llm):
    rows = [(1, k, "assistant" if k % 2 else "user", f"  some text\n{k} ") for k in range(40)]
    table = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_chats(table).collect()
    runs = sorted(chat.format_chats(table, run_chars=25).collect(), key=lambda r: r["run"])
    assert len(whole) == 1 and len(runs) > 10
    assert whole[0]["ids"] == [x for r in runs for x in r["ids"]] and whole[0]["loss"] == [x for r in runs for x in r["loss"]]


# --- 8

def page(k, body):
    return f"<html><head><title>t{k}</title></head><body><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav>{body}<footer>&copy; x</footer></body></html>"


CASES = [
    ("<article><h1>A &amp; B</h1><p><b>one<br><p>two&nbsp; three\n four</p></article>", "A & B\none\ntwo three four"),
    ("<main><p>x<p>y</main><aside>no</aside>", "x\ny"),
    ("<article><p>kept</p><form>f<input></form><div class='ad'>ad</div><div class=\"cookie-notice\">c</div><script>var a='<p>no</p>'</script><style>p{}</style>"
     "<!-- <p>no</p> --><section id=comments><article class=comment><p>reader</p></article></section></article>", "kept"),
    ("<div class=sidebar><p>no</p></div><div id=content><p>a<i>b</i>c</p><ul><li>one<li>two</ul></div>", "abc\none\ntwo"),
    ("<article><header><h1>T</h1><p>by x</p></header><table><tr><td>1<td>2</table><pre>a\n b</pre></article>", "T\n1\n2\na b"),
    ("<article><p>&lt;tag&gt; &#233;&#x1F600; &unknown; &am</p>", "<tag> é😀 &unknown; &am"),
    ("<article><p>never closed <b>bold", "never closed bold"), ("", ""), ("<article></article>", ""),
    ("<article><div role=navigation>n</div><div hidden>h</div><p>x</p></article>", "x"),
]


@pytest.mark.parametrize("body, text", CASES)
def test_main_text(body, text):
    assert wrapper.extract(page(1, body), {"content": None, "template": []}) == text


def test_wrapper_takes_constant_nodes_out():
    rng = random.Random(1)
    made = [page(k, f"<div><div>Subscribe to our daily letter</div><div><h2>title {rng.random()}</h2>" + "".join(f"<p>text {rng.random()}</p>" for _ in range(k)) + "</div></div>") for k in range(1, 6)]
    known = wrapper.induce(made)
    assert known == {"content": "html/body/div/div", "template": []} or ["html/body/div/div", "Subscribe to our daily letter"] in known["template"]
    for html in made:
        assert "Subscribe" not in wrapper.extract(html, known) and wrapper.extract(html, known).startswith("title")
    assert wrapper.induce(made[:2]) == {"content": None, "template": []}


def test_simple_tree_matching():
    a, b = wrapper.tree("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), wrapper.tree("<div><ul><li>y<li>z</ul><p>3</p></div>")
    pairs = []
    assert wrapper.matching(a, b, pairs) == 5  # root, div, ul, li, p
    assert sorted(x.tag for x, _ in pairs) == ["#root", "div", "li", "p", "ul"]


def test_pages(scratch, pages):
    rows = [(k, f"http://h{k % 2}.example/{k}", page(k, body)) for k, (body, _) in enumerate(CASES)]
    rows += [(100, None, None), (101, "no host", ""), (None, "http://h0.example/x", page(1, "<article>n</article>")), (102, "u", "<article>" + "<div>" * 3000 + "deep"),
             (103, "u", page(1, "<article><p>" + "long " * 60_000 + "</article>")), (104, "u", "<<<>>&&& </p></div>"), (104, "u", "<<<>>&&& </p></div>")]
    got = {}
    for r in wrapper.main_text(pages(rows), scratch).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for k, (_, text) in enumerate(CASES):
        assert got[k] == [text]
    assert got[100] == [""] and got[101] == [""] and got[None] == ["n"] and got[102] == ["deep"] and len(got[103][0]) == 60_000 * 5 - 1 and len(got[104]) == 2
    assert wrapper.main_text(pages([]), scratch).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><![ x", "a"), ("<p>a<![!--x", "a"), ("<![foo[x]]>", ""), ("<p>a<![CDATA[z]]>b", "ab"), ("<p>a</p><![endif]><p>b", "a\nb"), ("<p>a<![", "a")])
def test_marked_sections(html, text):
    assert wrapper.extract(html, {"content": None, "template": []}) == text


@pytest.mark.parametrize("body, text", [
    ("<article><p>x</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>", "x\none\ntwo"),
    ("<article><div class=related-work><p>x</p></div><section class=notice-period>y</section><div class='cookie-notice'>no</div></article>", "x\ny"),
    ("<div class=related-work><p>no</p></div><ul><li><a>no</a><li><a>no</a></ul><p>x</p>", "x")])
def test_class_words_and_lists_of_links(body, text):
    assert wrapper.extract(page(1, body), {"content": None, "template": []}) == text


def brute_matching(x, y):
    """Simple tree matching as published: by recursion, over (tag, children)."""
    if x[0] != y[0]:
        return 0
    table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
    for i, u in enumerate(x[1], 1):
        for j, v in enumerate(y[1], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_matching(u, v))
    return 1 + table[-1][-1]


trees = st.recursive(st.tuples(st.sampled_from(["b", "i", "u"]), st.just([])), lambda x: st.tuples(st.sampled_from(["b", "i", "u"]), st.lists(x, max_size=5)), max_leaves=25)


def markup(x):
    return f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"


@settings(max_examples=200, deadline=None)
@given(trees, trees)
def test_matching_is_the_best(x, y):
    a, b = wrapper.tree(markup(x)), wrapper.tree(markup(y))
    pairs = []
    assert wrapper.matching(a, b, pairs) == len(pairs) == brute_matching(("#", [x]), ("#", [y]))
    order = {id(n): k for k, n in enumerate(wrapper.Skeleton(a).nodes)}, {id(n): k for k, n in enumerate(wrapper.Skeleton(b).nodes)}
    at = sorted((order[0][id(u)], order[1][id(v)]) for u, v in pairs)
    assert [v for _, v in at] == sorted(v for _, v in at) and all(u.tag == v.tag for u, v in pairs)
    mapped = {(id(u), id(v)) for u, v in pairs}
    assert all(u.parent is None or (id(u.parent), id(v.parent)) in mapped for u, v in pairs)


def test_matching_in_order_of_appearance_beyond_the_table():
    a, b = (wrapper.Skeleton(wrapper.tree("".join(f"<p>{k}<{t}>" for k, t in enumerate(tags)))) for tags in ("bibib" * 3, "iiibb" * 3))
    few, most = wrapper.align(a, b, cells=4), wrapper.align(a, b)
    assert 1 < len(few) <= len(most) and all(a.nodes[i].tag == b.nodes[j].tag for i, j in few)


@pytest.mark.parametrize("made", [["<div>" * 3000 + f"deep {k}" for k in range(4)], ["<ul>" + "".join(f"<li>{k} {i}{'<b>x</b>' * ((i * k) % 3)}" for i in range(5000)) + "</ul>" for k in range(4)]])
def test_deep_and_long_pages(made):
    known = wrapper.induce(made)
    assert known["template"] == [] and all(len(wrapper.extract(html, known)) > 5 for html in made)


def words_of(rng, n):
    return " ".join(rng.choice(["erth", "onre", "shand", "thble", "ing", "thou", "hean"]) + str(rng.randrange(1000)) for _ in range(n))


def host_pages(rng, n, layout):
    """(html, text) of pages without article, main or telling names, in one of two layouts that each say some things on every page."""
    out = []
    for _ in range(n):
        ps = [words_of(rng, 12) for _ in range(rng.randrange(2, 6))]
        if layout == 0:
            html = f"<div class=x1><span>Our daily letter</span></div><div class=x2>{''.join(f'<p>{p}</p>' for p in ps)}</div><table><tr><td>Imprint of this site<td>{rng.random()}</table>"
            text = ps + [html.split("<td>")[2].removesuffix("</table>")]
        else:
            html = f"<section><h2>{ps[0]}</h2>{''.join(f'<blockquote>{p}</blockquote>' for p in ps[1:])}</section><dl><dt>Where we are<dd>In a town by a river</dl>"
            text = ps
        out.append((f"<html><body>{html}</body></html>", "\n".join(text)))
    return out


def test_wrappers_decide_over_all_pages(scratch, pages):
    """A host of mostly copies, one with two layouts, one of large pages, one with too few pages."""
    rng = random.Random(8)
    some, copy = host_pages(rng, 12, 0), host_pages(rng, 1, 0)[0]
    hosts = {"copies.example": some + [copy] * 150, "two.example": host_pages(rng, 40, 0) + host_pages(rng, 9, 1),
             "large.example": [(h.replace("</p></div>", f" {'long ' * 20_000}</p></div>"), t) for h, t in host_pages(rng, 6, 0)], "few.example": host_pages(rng, 2, 0)}
    rows = [(1000 * k + n, f"http://{name}/{n}", html) for k, (name, made) in enumerate(hosts.items()) for n, (html, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages(rows), scratch, share=20).collect()}
    assert len(got) == len(rows)
    changed = 0
    for k, (name, made) in enumerate(hosts.items()):
        for n, (html, text) in enumerate(made):
            plain = wrapper.extract(html, {"content": None, "template": []})
            found = got[1000 * k + n]
            changed += found != plain
            if name == "few.example":
                assert found == plain
            elif name == "large.example":
                assert "letter" not in found and "Imprint" not in found and found.count("long") >= 20_000
            else:
                assert found == text
    assert changed == len(rows) - 2


def test_wrappers_of_tables_are_those_of_lists(llm, scratch, pages):
    rng = random.Random(9)
    made = {f"h{k}.example": [h for h, _ in host_pages(rng, 3 + 2 * k, k % 2)] + [h for h, _ in host_pages(rng, k, 1 - k % 2)] for k in range(6)}
    rows = [(n, f"https://{name}/{n}", html) for name, some in made.items() for n, html in enumerate(some)]
    got = {r["host"]: r["wrapper"] for r in wrapper.wrappers(pages(rows), scratch, "url", "html", share=3).collect()}
    hashes = {r["html"]: r["h"] for r in pages(rows).selectExpr("html", "xxhash64(html) AS h").collect()}
    for name, some in made.items():
        known = wrapper.induce(sorted(some, key=hashes.get))["template"]
        assert (json.loads(got[name]) if name in got else []) == known
    assert got


def test_near_copies_are_no_template(scratch, pages):
    """Pages that differ in a few words keep what they share."""
    text = [words_of(random.Random(1), 30) for _ in range(6)]
    rows = [(k, f"http://n.example/{k}", "<body>" + "".join(f"<p>{p}</p>" for p in text) + f"<p>word {k}</p></body>") for k in range(20)]
    for r in wrapper.main_text(pages(rows), scratch).collect():
        assert r["text"] == "\n".join([*text, f"word {r['page_id']}"])


def test_query_of_pages(llm):
    """The registered query: its columns, and texts equal to those of the pages' articles."""
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in entry.queries()["op8_wrapper_text"](llm, folder).collect()}
    rows = llm.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = wrapper.extract(r["html"] or "", {"content": None, "template": []})
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], text, len(text))
