"""Main text of pages whose parts are known: several layouts a host, wrappers with misleading names, hosts of one page."""

import random

import pytest

from piisift.llm import html_text

NAV = "<nav><ul><li><a href='/a'>{0}</a></li><li><a href='/b'>{1}</a></li></ul></nav>"
FOOT = "<footer><p>Copyright {0} terms of use</p></footer>"
COMMENTS = "<section id='comments' class='comments-area'><ol><li><article class='comment'><p>Reader says {0}</p></article></li></ol></section>"


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(99)) for _ in range(n))


def article(rnd):
    blocks = [words(rnd, rnd.randrange(20, 60)) + "." for _ in range(rnd.randrange(1, 4))]
    return blocks, "".join(f"<p>{b}</p>" for b in blocks)


LAYOUTS = {
    "plain": lambda a, rnd: f"<body>{NAV.format(words(rnd, 2), words(rnd, 1))}<article>{a}</article><div class='ad'>{words(rnd, 8)}</div>{FOOT.format(words(rnd, 2))}</body>",
    "has-sidebar": lambda a, rnd: f"<body>{NAV.format(words(rnd, 2), words(rnd, 1))}<main class='has-sidebar'><article class='post share-enabled'>{a}</article>"
                                  f"<aside class='sidebar'><p>{words(rnd, 9)}</p></aside></main>{COMMENTS.format(words(rnd, 6))}</body>",
    "with-sidebar": lambda a, rnd: f"<body><div class='page with-sidebar'><div id='sidebar'><p>{words(rnd, 7)}</p></div><article>{a}</article></div>{FOOT.format(words(rnd, 2))}</body>",
    "form": lambda a, rnd: f"<body><form id='aspnetForm'><div class='topbar'>{words(rnd, 3)}</div><article>{a}</article><div class='newsletter'>{words(rnd, 6)}</div></form></body>",
    "social wrapper": lambda a, rnd: f"<body><div class='social'><main>{a}</main></div><div class='related'><article><p>{words(rnd, 5)}</p></article></div></body>",
    "no names": lambda a, rnd: f"<body><ul><li><a href='/x'>{words(rnd, 3)}</a></li></ul><div><table><tr><td>{a}</td></tr></table></div><ul><li><a href='/y'>{words(rnd, 2)}</a></li></ul></body>",
}


def run(spark, pages):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, text string")
    return {r["page_id"]: r["text"] for r in html_text.extract_pages(df.repartition(3)).collect()}


@pytest.mark.parametrize("layouts,pages", [(["plain"], 8), (["has-sidebar"], 6), (["with-sidebar"], 6), (["form"], 6), (["no names"], 8),
                                           (["social wrapper"], 5), (["has-sidebar", "form"], 8), (["plain", "with-sidebar"], 9)])
def test_hosts_of_known_layouts(spark, layouts, pages):
    rnd = random.Random(len(layouts) * 100 + pages)
    made, want = [], {}
    for i in range(pages):
        blocks, a = article(rnd)
        made.append((i, "http://h.example/p", f"<html><head><title>t</title></head>{LAYOUTS[layouts[i % len(layouts)]](a, rnd)}</html>"))
        want[i] = "\n".join(blocks)
    assert run(spark, made) == want


@pytest.mark.parametrize("layout", [name for name in LAYOUTS if name not in ("no names", "social wrapper")])
def test_hosts_of_one_page(spark, layout):
    rnd = random.Random(3)
    blocks, a = article(rnd)
    assert run(spark, [(1, "http://one.example/", LAYOUTS[layout](a, rnd))]) == {1: "\n".join(blocks)}


def test_text_of_the_template_inside_articles(spark):
    """A box that reads the same on every page is left out; one that differs stays, and so does an article met five times."""
    rnd = random.Random(5)
    page = "<body><article><p>{0}</p><div class='box'><p>Read our terms before use</p></div><div class='note'><p>{1}</p></div></article></body>"
    made = [(i, "http://box.example/", page.format(words(rnd, 20), words(rnd, 5))) for i in range(6)]
    got = run(spark, made)
    assert all("terms before use" not in t and t.count("\n") == 1 for t in got.values())
    same = [(i, "http://same.example/", made[0][2]) for i in range(6)]
    assert all("terms before use" in t for t in run(spark, same).values())


def test_repeated_rows_do_not_cancel(spark):
    """Two pairs of equal pages: classes of one pair are not those of the other."""
    rows = [("h", i, p) for i, p in enumerate(["<div><p>a</p></div>"] * 2 + ["<ul><li>b</li></ul>"] * 2)]
    got = html_text.deduce_templates(spark.createDataFrame(rows, "host string, page long, t string")).collect()
    by = {r["token"]: r["vector"] for r in got[0]["template"]}
    assert by["div"] != by["ul"] and got[0]["pages"] == 4
