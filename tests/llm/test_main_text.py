"""Pages whose article holds short, linked, quoted or oddly encoded parts."""

from pyspark.sql import functions as F

from tallyhouse.llm import main_text

PROSE = "A paragraph of the text, with some clauses, and full stops. It goes on for a while, as prose does."
LINKED = '<ul><li><a href="1">Chapter one</a></li><li><a href="2">Chapter two</a></li></ul>'
CASES = {
    f"<body><nav>Menu</nav><article><p>{PROSE}</p><ol><li>a</li><li>b</li></ol><p>{PROSE}</p></article></body>": [PROSE, "a", "b", PROSE],
    f"<article><p>{PROSE}</p>{LINKED}<p>{PROSE}</p></article><div>{LINKED}</div>": [PROSE, "Chapter one", "Chapter two", PROSE],
    f"<article><p>{PROSE}</p><p>{PROSE}</p><div><a>Source: the county archive</a></div></article>": [PROSE, PROSE, "Source: the county archive"],
    f"<article><h1>T</h1><header><p>By somebody, on a day.</p></header><p>{PROSE}</p><p>{PROSE}</p></article>": ["T", "By somebody, on a day.", PROSE, PROSE],
    f"<article><p>{PROSE}</p><blockquote><p>{PROSE}</p><footer>Somebody, Letters</footer></blockquote><footer>Filed under x</footer></article>": [PROSE, PROSE, "Somebody, Letters"],
    f"<article><p>{PROSE}</p><p>AT&<b>lt;</b>x &#65<i>6</i> &amp;lt; &am<!-- -->p;</p></article>": [PROSE, "AT&lt;x A6 &lt; &am p;".replace("&am p", "&amp")],
    f"<article><p>{PROSE}</p><p>Choose <button>this</button> now<input>.</p><p>{PROSE}</p></article>": [PROSE, "Choose now.", PROSE],
    f'<article><p>{PROSE}</p><div class="comments"><p>Nice.</p></div><nav>{LINKED}</nav><form>Mail</form><aside>Side.</aside></article>': [PROSE],
    f'<article><p>{PROSE}</p><p>{PROSE}</p><section><article><a>A teaser</a></article></section></article>': [PROSE, PROSE],
    f'<body><div><p>{PROSE}</p><p>{PROSE}</p></div><article><a>A teaser</a></article></body>': [PROSE, PROSE],
}


def test_all_of_a_chosen_article(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "page_id long, html string").withColumns({"url": F.lit("u"), "text": F.lit(7), "n_chars": F.lit("x"), "__html": F.lit(0)})
    got = {r.page_id: r for r in main_text.extract_main_text(frame.drop("__html")).collect()}
    assert {k: r.text.split("\n") for k, r in got.items()} == dict(enumerate(CASES.values()))
    assert all(r.n_chars == len(r.text) and r.url == "u" for r in got.values())
    clashing = {r.page_id: r.text for r in main_text.extract_main_text(frame).collect()}
    assert clashing == {k: r.text for k, r in got.items()}


def test_one_element_of_many_pages_is_read_alike():
    page = next(iter(CASES))
    assert main_text.main_text(page * 1, whole_article=True) == main_text.main_text(page.replace("<body>", "<body>" + "<div>" * 50), whole_article=True)
    assert main_text.main_text("", whole_article=True) == "" and main_text.main_text("<article></article>", whole_article=True) == ""
