"""Style trees against plain counting, and pages that no name or role helps with."""

import math
import random
import time
from collections import Counter, defaultdict

from marlstone.llm import extract

PAGE = "page_id long, url string, html string"


def brute(pages, least_pages, ratio, least_content):
    """{host: {(parent, path): best}} from all looks and texts of each node."""
    held = defaultdict(list)
    for host, page in pages:
        for key, found in extract.seen_nodes(extract.parse(page or "")).items():
            held[(host, *key)].append(found)
    children = defaultdict(dict)

    def entropy(items):
        n = len(items)
        return -sum(c / n * math.log2(c / n) for c in Counter(items).values())

    for (host, parent, path, branch), found in held.items():
        if len(found) >= least_pages:
            texts = {(look, text): words for look, text, words in found}
            bits = entropy([look for look, _ in texts]) + math.log2(1 + sum(texts.values()) / len(texts))
            children[host, parent][path] = bits, branch, entropy([x[:2] for x in found]) / math.log2(len(found))
    out = defaultdict(dict)
    for (host, parent), own in children.items():
        best = max(own, key=lambda p: own[p][0])
        out[host] |= {(parent, p): best for p, (bits, branch, content) in own.items() if p != best and branch and ((content < least_content and content < own[best][2] / 2) or (own[best][1] and bits < ratio * own[best][0]))}
    return dict(out)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def site(r, pages=30):
    """Pages without a telling name: a list of links, a slot for short texts, the text, a fixed line and a closing line."""
    out = []
    for _ in range(pages):
        body = [words(r, r.choice([20, 60, 200, 500])) for _ in range(r.randint(1, 6))]
        links = "".join(f"<li><a href=x>{words(r, 1)}</a>" for _ in range(6))
        out.append((f"<body><div class=a><ul>{links}</ul></div><div class=b>{words(r, 7)}</div><div class=c id=n{r.randint(1, 99)}><h2>{words(r, 4)}</h2>{''.join(f'<p>{x}</p>' for x in body)}<div>Send this page to a friend</div></div><div class=d>{words(r, 6)} by the same house</div>", body))
    return out


def test_noise_against_plain_counting(spark):
    r = random.Random(31)
    rows = [(k, f"http://{'ab'[k % 2]}.org/{k}", page) for k, (page, _) in enumerate(site(r, 40))]
    rows += [(k, "http://c.org/", "<body><div><p>" + words(r, r.randint(1, 4)) + "</p></div><section>" + words(r, 30) * r.randint(1, 3) + "</section>") for k in range(50, 70)] + [(90, None, None), (91, "http://few.org", "<p>x")]
    found = {x.host: {(n.parent, n.path): n.best for n in x.noise} for x in extract.noise_paths(spark.createDataFrame(rows, PAGE), 8, 0.5, 0.2).collect()}
    want = brute([("" if u is None else u.split("/")[2], h) for _, u, h in rows], 8, 0.5, 0.2)
    assert set(found) == {"a.org", "b.org", "c.org"} and all(len(x) >= 1 for x in found.values())
    assert {h: x for h, x in found.items() if x} == {h: x for h, x in want.items() if x}


def test_the_tree_finds_the_text_where_no_name_tells_it(spark):
    r = random.Random(32)
    pages = site(r)
    rows = [(k, f"http://a.org/{k}", page) for k, (page, _) in enumerate(pages)]
    out = {x.page_id: x for x in extract.extract(spark.createDataFrame(rows, PAGE), by_name=False).collect()}
    for k, (_, body) in enumerate(pages):
        assert out[k].text.split("\n")[1:] == body and out[k].n_noise == 4


def test_copies_of_a_page_are_no_noise(spark):
    r = random.Random(33)
    text = f"<article><p>{words(r, 80)}</p></article>"
    rows = [(k, "http://a.org/", f"<body><div>{words(r, 5)}</div>{text if k < 57 else f'<article><p>{words(r, 50)}</p></article>'}<div id=f>{words(r, 8)}</div>") for k in range(60)]
    out = extract.extract(spark.createDataFrame(rows, PAGE), by_name=False).collect()
    article = {x[0]: x[2].split("<article><p>")[1].split("</p>")[0] for x in rows}
    assert all(article[x.page_id] in x.text.split("\n") for x in out)


def test_pages_without_the_best_branch_keep_the_others(spark):
    r = random.Random(34)
    rows = [(k, "http://a.org/", f"<body><div>{words(r, 5)}</div>" + (f"<section><p>{words(r, r.randint(40, 400))}</p></section>" if k else "")) for k in range(30)]
    out = {x.page_id: x.text for x in extract.extract(spark.createDataFrame(rows, PAGE), by_name=False).collect()}
    assert len(out[0].split()) == 5 and min(len(out[k].split()) for k in range(1, 30)) >= 40


def test_hostile_pages_take_time_in_proportion():
    for part in ("<a ", '<a "', "<a '\"", "<b>", "</i>", "<!--", "<p", "<table><tr>", '<a href="x">', "<p><b>", "&amp", "<script>"):
        began = time.time()
        for page in (part * (200_000 // len(part)), "<div>" + part * (200_000 // len(part)) + "end"):
            extract.main_text(page)
            extract.seen_nodes(extract.parse(page))
        assert time.time() - began < 8, part
    assert extract.main_text("<p>one <a href='x>two</a> three") == "one two three"
    assert extract.main_text('<p>one<a title="a > b">two</a><p>three<a ') == "onetwo\nthree"
