"""HTML, languages, archives, quality, toxicity and the pipeline."""

import base64
import hashlib
import html
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import harness
from entigraph.llm import html_extract, language_id, quality_rules, queries, toxicity, warc

PAGE = """<html><head><title>T</title></head><body class=home><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>side</p></div>
<div class="post-content"><h2>Head &amp; line</h2><p>One <i>two</i>three<br>four.<p>Five&nbsp;six <a href=x>link</a><ul><li>a<li>b</ul><form><input><p>mail</p></form><table><tr><td>x<td>y</table></div>
<div class="comments"><p>nice</p></div></div><script>if(a<b){"</p>"}</script><footer>f</footer><p>tail"""


def test_extract():
    assert html_extract.extract(PAGE) == "Head & line\nOne twothree four.\nFive six link\na\nb\nx y"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p><!-- x") == ""
    assert html_extract.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.extract("<p>a<p>b < c") == "a\nb < c"
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert html_extract.extract(long).count("\n") == 19_999


def slow_text(page):
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.DOTALL)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", body[1])] if body else []
    return "\n".join(b for b in blocks if b)


def test_html_query(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op1_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    assert all(r.text == slow_text(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_template_without_telling_names(spark):
    """Elements named by nothing: the template finds the region, and constant text of it is dropped."""
    page = "<html><body><div class='q1'><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></div><div class='q2'><div class='q3'><p>Shared words on top</p>{}</div></div><div class='q4'><a href='/'>Imprint</a></div></body></html>"
    rows = [(k, "http://a.example/x", page.format("".join(f"<p>Story {k} part {j} with some more words to read</p>" for j in range(3 + k % 2))), "z") for k in range(12)]
    rows += [(50, "http://b.example/", page.format("<p>Alone on a host</p>"), "z"), (51, None, None, "z"), (52, "bad url", "", "z")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[4] == "\n".join(f"Story 4 part {j} with some more words to read" for j in range(3))
    assert "Alone on a host" in got[50] and got[51] == got[52] == ""
    assert "Home" not in got[5] and "Imprint" not in got[5]
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nothing_of_the_article_is_left_out(spark):
    words = "<p>Story {0} tells of {0} boats with many more words to read on</p>" * 60
    page = "<html><body class='single-post'><p>Above</p><article><h1><a href='/'>Title {0}</a></h1><p>Lead {0}</p><div class='entry-content'>" + words + "</div><p>Last {0}</p></article><p>Below</p></body></html>"
    want = "Title {0}\nLead {0}\n" + "\n".join(["Story {0} tells of {0} boats with many more words to read on"] * 60) + "\nLast {0}"
    assert html_extract.extract(page.format(7)) == want.format(7)
    rows = [(k, "http://a.example/", page.format(k)) for k in range(8)] + [(50, "http://b.example/", page.format(50))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want.format(k) for k in got} and len(got) == 9


def test_attributes_count_by_their_whole_names():
    for attribute in ('style="overflow:hidden"', 'href="/hidden-valley"', "data-hidden", "data-role='navigation'", 'title="class=\'menu\'"', "data-id=sidebar"):
        assert html_extract.extract(f"<article><div {attribute}><p>Kept</p></div></article>") == "Kept", attribute
    for attribute in ("hidden", 'HIDDEN=""', "aria-hidden='true'", "x=1 class='menu'", "role=navigation", 'alt="a b"hidden'):
        assert html_extract.extract(f"<article><p>Kept</p><div {attribute}><p>Out</p></div></article>") == "Kept", attribute


def test_copies_are_no_template(spark):
    page = "<html><body><nav>menu</nav><article><p>The same article on most pages of the host, word for word</p></article></body></html>"
    other = page.replace("The same", "Another")
    rows = [(k, "http://a.example/", page if k < 9 else other) for k in range(10)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("The same article") and got[9].startswith("Another article")


def test_languages(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op2_language_id(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.002 * len(rows)


FOREIGN = {
    "pl": "Wczoraj po południu poszliśmy z dziećmi do parku, gdzie rosną stare drzewa. Później wróciliśmy do domu i przygotowaliśmy wspólnie kolację. ",
    "fi": "Eilen iltapäivällä menimme lasten kanssa puistoon, jossa kasvaa vanhoja puita. Myöhemmin palasimme kotiin ja valmistimme yhdessä illallisen. ",
    "tr": "Dün öğleden sonra çocuklarla birlikte yaşlı ağaçların büyüdüğü parka gittik. Daha sonra eve döndük ve birlikte akşam yemeği hazırladık. ",
    "nl": "Gistermiddag gingen wij met de kinderen naar het park waar oude bomen groeien. Later keerden we terug naar huis en maakten samen het avondeten klaar. ",
    "hu": "Tegnap délután elmentünk a gyerekekkel a parkba, ahol öreg fák nőnek. Később hazatértünk, és közösen elkészítettük a vacsorát. ",
    "it": "Ieri pomeriggio siamo andati con i bambini al parco dove crescono vecchi alberi. Più tardi siamo tornati a casa e abbiamo preparato insieme la cena. ",
}


def test_foreign_and_random_letters_are_rejected(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    coded = base64.b64encode(bytes(rng.randrange(256) for _ in range(900))).decode()
    more = [*FOREIGN.values(), *(t * 8 for t in FOREIGN.values()), junk, junk * 5, coded]
    table = docs.unionByName(spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(more)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.accepted(table).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_language_edges(spark):
    rows = [(k, w * 20, lang) for k in range(30) for w, lang in (("the house of ", "en"), ("das haus und der ", "de"))]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (None, "the house", None), (903, "the house of the " * 9000, None), (904, "жжжщщщ ъъъ ыыы", None)]
    table = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identified(table).collect()}
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"} and got[902].score == 0.0
    assert got[None].lang_pred == got[903].lang_pred == "en" and got[904].rejected and got[904].lang_pred in ("en", "de")
    kept = language_id.accepted(table)
    assert kept.columns == table.columns and not {900, 901, 902, 904} & {r.doc_id for r in kept.collect()} and kept.count() == len(rows) - 4
    unlabelled = language_id.identified(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language_id.identified(table.limit(0)).count() == 0


def test_archive_query(spark, small):
    assert harness.difference(queries.op4_warc_archive(spark, small), small, warc.ORACLE_SQL) == ""


def test_archive_files(spark, tmp_path):
    same = "<p>" + "same " * 40
    rows = [(k, f"http://a/{k}", f"<p>page {k} {'é' * (k % 90)}") for k in range(60)] + [(70, "u", same), (71, "u", same), (71, "v", same), (72, None, None), (73, "u", ""), (None, "u", same), (None, "w", "x"), (10**12, "far", same), (80, "b", "tiny"), (81, "b", "tiny")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, payload_bytes int")
    roots = [str(tmp_path / n) for n in "ab"]
    for root in roots:
        warc.write(pages, root, shard_bytes=300, roll_bytes=400)
    names = [sorted(n for n in os.listdir(r) if n.endswith("gz")) for r in roots]
    assert names[0] == names[1] and len(names[0]) > 5 and not [n for n in os.listdir(roots[0]) if n.startswith(".pages")]
    assert all(open(f"{roots[0]}/{n}", "rb").read() == open(f"{roots[1]}/{n}", "rb").read() for n in names[0])
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, roots[0]).collect()), key=repr)
    want = []
    for key, _, text in rows:
        data = (text or "").encode()
        copy = text == same and key != 70
        want.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", 70 if copy else None))
    assert got == sorted(want, key=repr)
    stored = {r.page_id: bytes(r.payload) for r in warc.read(spark, roots[0]).where("record_type = 'response' and page_id is not null").collect()}
    assert stored[70] == same.encode() and stored[5] == rows[5][2].encode()
    path = f"{roots[1]}/{names[1][0]}"
    data = bytearray(open(path, "rb").read())
    data[-30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read(spark, roots[1]).collect()
    warc.write(pages.limit(0), str(tmp_path / "empty"))
    assert warc.read(spark, str(tmp_path / "empty")).count() == 0


def slow_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_query(spark, small):
    assert harness.difference(queries.op6_quality_rules(spark, small), small, quality_rules.ORACLE_SQL) == ""


def test_quality_edges(spark):
    texts = [None, "", " \n\t ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40_000, "line\nline \nline\n\n\n", "é # * $%&|<> 中", "\x1ca\x1fb \x0b \x0c c", " ".join(map(str, range(100))) + " 1 2 3 4 5 6 7 8"]
    rows = [(k, t, "h" if k % 2 else None, True) for k, t in enumerate(texts)] + [(9, texts[9], "h", False)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, kept boolean")
    found = quality_rules.judged(table).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted((k, *slow_rules(t)) for k, t, *_ in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found)
    assert quality_rules.judged(table.limit(0)).count() == 0


def test_hosts_are_shrunk(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good if k % 10 else "bad", f"host{k % 40}") for k in range(4000) if k % 40 not in (7, 8)]
    rows += [(9000 + k, good if k % 10 == 0 else "bad", "awful") for k in range(200)] + [(9500, good, "small"), (9501, "bad", "small"), (9600, good, None)]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[9000] and kept[9500] and kept[9600] and kept[11]


def test_toxicity_query(spark, small):
    sf = small.replace("0.001", "0.1")
    rows = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hit, miss, wrong = (sum(r.toxic == a and r.predicted == b for r in held) for a, b in ((1, 1), (1, 0), (0, 1)))
    assert hit > 0.9 * (hit + miss) and wrong <= 0.015 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def small_model(spark):
    clean = ["the river runs by the old mill", "she reads a book at home", "they idle on a lake", "is a total of three"]
    rows = [(k, f"{clean[k % 4]} idiot {clean[(k + 1) % 4]}" if k % 3 == 0 else f"{clean[k % 4]} {clean[(k + 2) % 4]} {k}", int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_deobfuscation(spark, small_model):
    docs, labels = small_model
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.weights["idiot"] > 0
    for disguise in ("idiot", "IDIOT!", "1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "!di0t", "i-d-i-o-t", "I D 1 O T", "a i d i o t", "i d i o t a", "mill.idiot", "t h e o l d " * 9 + "1 d i o t", "-.".join("theoldmill" * 9) + ".i-d-i-o-t"):
        assert model.score(f"the old {disguise} runs") >= 0.3, disguise
    for clean in ("", "the old river runs", "a b c d e f", "call 1-800-555 at 10:30", "looooong river", "x = 1d10", "mail me@home.example 12"):
        assert model.score(clean) < 0.3, clean


def test_deobfuscation_of_any_separator_or_repetition(spark, small_model):
    docs, labels = small_model
    model = toxicity.fit(docs, labels, F.lit(True))
    disguises = ["iidiioott", "idioot", "i - d - i - o - t", "i . d . i . o . t", "i#d#i#o#t", "i=d=i=o=t", "id io t", "i di ot", "is on a id io t", "i ! d ! i ! o ! t", "i|d|i|o|t", "mill#idiot", "1d = 10 = t", "i == d == i == o == t"]
    disguises += [z.join("idiot") for z in ("\u200b", "\u200d", "\u00ad", "\ufeff")]
    for disguise in disguises:
        assert model.score(f"the old {disguise} runs") >= 0.3, disguise
    for clean in ("book mill rabbit", "he is at it on a lake", "a = b = c", "a - b - c - d - e - f", "the#old#river", "th\u200be ri\u00adver", "is it 10 or 11", "a | b | c | d"):
        assert model.score(clean) < 0.3, clean


def test_toxicity_edges(spark, small_model):
    docs, labels = small_model
    more = spark.createDataFrame([(9000, None), (9001, ""), (None, "idiot"), (9002, "old " * 50_000 + "1d10t"), (3, "idiot")], docs.schema)
    noisy = labels.unionByName(spark.createDataFrame([(77_777, 1), (None, 1), (5, None), (6, 0)], labels.schema))
    table = docs.unionByName(more).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.scored(table, noisy).collect()}
    assert got[9000].score == got[9001].score <= toxicity.BASE_SCORE and got[None].predicted == got[9002].predicted == 1
    assert got[9].held_out == (zlib.crc32(b"9") % 4 == 2)
    kept = toxicity.accepted(table, noisy)
    assert kept.columns == table.columns and kept.where("text like '%idiot%'").count() == 0 and kept.where("doc_id in (9000, 9001)").count() == 2
    assert toxicity.scored(table.limit(0), noisy).count() == 0
    assert {round(r.score, 9) for r in toxicity.scored(table, noisy.limit(0)).collect()} == {toxicity.BASE_SCORE}


def test_pipeline(spark, small):
    import corpus_pipeline
    from test_dedup import labels as grouped
    from test_dedup import shingles
    from test_tokens import check_packing, expected_pieces

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, small).collect() if r.predicted}
    rest = docs.where(~F.col("doc_id").isin(*toxic)) if toxic else docs
    rejected = {r.doc_id for r in language_id.identified(rest).collect() if r.rejected}
    left = [(r.doc_id, r.text) for r in rest.collect() if r.doc_id not in rejected]
    sets = [set(shingles(t, 5)) for _, t in left]
    pairs = [(i, j) for i in range(len(left)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    first = grouped(len(left), pairs, [k for k, _ in left])
    final = [d for d, c in zip(left, first) if d[0] == c]
    check_packing(corpus_pipeline.run(spark, small).collect(), expected_pieces(final, 2048), 2048)
    stage = corpus_pipeline.STAGES[2][1](spark, rest.limit(0), small)
    assert stage.columns == docs.columns and stage.count() == 0
