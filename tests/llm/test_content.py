import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import attention_lm, boosting, html_extract, lm_scoring, media, registry, toxicity, url_filter
from emberline.llm.common import table

from .conftest import HARD


def url_reference(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:] if rest[end : end + 1] == "/" else ""
    for c in "?#":
        path = path.split(c)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in rest[:end]), path


def rule_reference(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "https://EXAMPLE.org/es/x?q#f", "http://sub.example.org/en/12", "http://example.org", "http://example.org?x=/es/", "http://a.com/fr/", "http://a.com/de/x#y",
            "http://org/", "http://xorg/es/", "http://notexample.org/es/", "http://example.org./es/", "http://com/fr/a", "ftp://user@a.b.net:80/p", "http://éx.org/ä", "http://example.org/es/", "http://example.org/es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = url_filter.match_rules(df).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = url_reference(urls[r["page_id"]])
        assert (r["host"], r["path"], (r["rule"], r["verdict"])) == (host, path, rule_reference(host, path)), urls[r["page_id"]]
    assert url_filter.match_rules(df.limit(0)).count() == 0


def test_url_path_follows_the_host(spark):
    """A later url with a path, in the query or fragment of one without, gives no path."""
    urls = ["http://a.example.org?u=http://b.com/es/x", "http://example.org#http://b.com/es/x", "http://example.org?x://y", "http://a.com/de/?u=http://b.com/fr/"]
    found = url_filter.match_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = url_reference(urls[r["page_id"]])
        assert (r["host"], r["path"], (r["rule"], r["verdict"])) == (host, path, rule_reference(host, path)), urls[r["page_id"]]


def test_nested_rules(spark):
    rules = [("b.a.org", "/", "block"), ("a.org", "/", "allow"), ("org", "/x/", "block"), ("c.org", "/", "block")]
    df = spark.createDataFrame([(0, "http://z.b.a.org/x/"), (1, "http://a.org/y"), (2, "http://q.org/x/1"), (3, "http://q.org/y"), (4, "http://c.org/x/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.match_rules(df, rules).collect()} == {0: "b.a.org/", 1: "a.org/", 2: "org/x/", 3: None, 4: "org/x/" if len("org/x/") > len("c.org/") else "c.org/"}


def brute_hash(lines):
    """The cosine hash by plain sums."""
    tall, wide = lines.shape
    edge = lambda n, i: (i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1))
    small = [[np.mean([[float(v) for v in row[slice(*edge(wide, j))]] for row in lines[slice(*edge(tall, i))]]) for j in range(32)] for i in range(32)]
    cosine = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(cosine[u][i] * small[i][j] * cosine[v][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low)[31:33]
    return f"{int(''.join('1' if x > sum(middle) / 2 else '0' for x in low), 2):016x}"


def test_png_round_trip(hard):
    stored = media.media_columns(hard)
    kept = {r["doc_id"]: r for r in stored.collect()}
    rows = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    for r in hard.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) if raw else bytes(64)
        got, png = rows[r["doc_id"]], bytes(kept[r["doc_id"]]["media"])
        assert (got["n_bytes"], got["payload_bytes"]) == (len(raw), len(padded))
        assert got["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got["tail_crc32"] == zlib.crc32(padded[-64:])
        assert media.read_png(png).tobytes() == padded and hashlib.sha256(png).hexdigest() == got["media_sha256"] and got["media_bytes"] == len(png)
        if len(raw) < 3000:
            assert got["feature"] == brute_hash(np.frombuffer(padded, dtype=np.uint8).reshape(-1, 64))
    assert rows[16]["feature"] == rows[13]["feature"] and media.media_columns(hard.limit(0)).count() == 0
    assert media.media_features(media.media_columns(hard.limit(0))).count() == 0


def test_media_query(spark, sf):
    """The registered query, from stored bytes, against the texts."""
    found = {r["doc_id"]: r for r in media.op6_media(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        raw = (r["text"] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) if raw else bytes(64)
        assert found[r["doc_id"]]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and found[r["doc_id"]]["n_bytes"] == len(raw)


def test_png_all_filters_and_faults():
    lines = np.random.default_rng(0).integers(0, 256, (40, 7), dtype=np.uint8)
    kinds = np.arange(40) % 5
    coded = lines.astype(np.int64).copy()
    for y in range(40):
        for x in range(7):
            a = int(lines[y, x - 1]) if x else 0
            b = int(lines[y - 1, x]) if y else 0
            c = int(lines[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded[y, x] -= [0, a, b, (a + b) // 2, paeth][kinds[y]]
    assert (media.unfilter(kinds.astype(np.uint8), (coded % 256).astype(np.uint8)) == lines).all()
    good = media.write_png(bytes(range(128)))
    for bad in (b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-5]):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_png_is_read_by_another_reader():
    pil = pytest.importorskip("PIL.Image")
    import io

    data = bytes(range(256)) * 3
    assert pil.open(io.BytesIO(media.write_png(data))).tobytes() == data


def test_html():
    cases = {
        "<main><article><h1>H</h1><p>One &amp; two&nbsp;three<br>four <b>and</b> five</p><aside>no</aside><form>f</form><p>six<table><tr><td>c1<td>c2</table>"
        "<section id=comments><article class=comment><p>I say.</p></article></section></article></main>": "H\nOne & two three four and five\nsix\nc1\nc2",
        "<nav><ul><li>m<article><p>Body text.</p></article>": "Body text.",
        "<body><div class='menu'><a>x</a></div><div class='post'><h2>T</h2><p>Hello there, a long paragraph. It has words, commas.</p><p>Short.</p></div><div class=box><a>l</a></div>": "T\nHello there, a long paragraph. It has words, commas.\nShort.",
        "plain text": "plain text", "": "", "<p>": "", "<article><script>x='<p>no</p>'</script>yes</article>": "yes", "<article><p>a<p>b<li>c<li>d</article>": "a\nb\nc\nd",
        "<article><!-- x --><p>a &lt;b&gt; &#233;</p></article><footer>f</footer>": "a <b> é",
    }
    for source, expected in cases.items():
        assert html_extract.main_text(source) == expected, source
    assert html_extract.main_text(None) == ""
    assert html_extract.main_text("<p>" + "a " * 50_000 + "</p>") == ("a " * 50_000).strip()
    html_extract.main_text("<img " + " ".join(f'a{i}="{i}"' for i in range(200)))  # ends at all


def test_html_pages(spark, sf):
    import html as entities
    import re

    for r in html_extract.extract(table(spark, sf, "pages").withColumn("text", F.lit("clash"))).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_landmarks_without_the_text():
    """Articles that are only teasers, beside a div, in a main element, beside the article."""
    text = [f"Paragraph {i} of the story is long, with commas, and more than one sentence. It goes on and on, as stories do." for i in range(4)]
    post = "<h1>T</h1>" + "".join(f"<p>{t}</p>" for t in text)
    whole = "\n".join(["T", *text])
    for n in (1, 3, 20):
        teasers = "".join(f"<article><h3>Card {i}</h3><p>Blurb {i}, more.</p></article>" for i in range(n))
        for source in (f"<div class=post>{post}</div><div class=cards>{teasers}</div>", f"{teasers}<div class=post>{post}</div>", f"<main>{post}{teasers}</main>",
                       f"<article>{post}</article>{teasers}", f"<main><article>{post}</article>{teasers}</main>", f"<div class=post>{post}</div><main>{teasers}</main>"):
            assert html_extract.main_text(f"<body>{source}</body>") == whole, source
    like = [f"<article><h2>A{j}</h2><p>{text[j]}</p><ul><li>x{j}</ul></article>" for j in range(4)]  # side by side: all content
    for source in ("".join(like), f"<main>{''.join(like)}</main>"):
        assert html_extract.main_text(source) == "\n".join(f"A{j}\n{text[j]}\nx{j}" for j in range(4))


def test_html_threshold_decides(spark, sf):
    """Without the threshold on path scores, menus, adverts and footers that no mark gives away come through."""
    import re

    pages = [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    bare = [re.sub(r"<(/?)(nav|header|footer|aside|form|article|main|section|ul|li)\b", r"<\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", p)) for p in pages]
    changed = [html_extract.content_blocks(html_extract.Page(p), 0) != html_extract.content_blocks(html_extract.Page(p)) for p in bare]
    assert sum(changed) > len(pages) / 4
    long = "A long paragraph of the story, with commas, and more. It goes on, and on. " * 3
    source = f"<body><div class=menu><a>Home</a></div><p>{long}<p>{long}<div class=x7><a>One</a></div></body>"
    assert html_extract.main_text(source) == f"{long.strip()}\n{long.strip()}"
    assert "Home" not in html_extract.content_blocks(html_extract.Page(source), 0) and "One" in html_extract.content_blocks(html_extract.Page(source), 0)
    assert html_extract.main_text(f"<body><article>x</article><p>{long}<p>{long}</body>") == f"{long.strip()}\n{long.strip()}"


def test_html_comments_and_short_neighbours():
    """Many short paths don't lower the bar to comments, however many or long these are; short neighbours of the text stay."""
    text = "".join(f"<p>Paragraph {i} says a lot of things, in a long line, that goes on for a while.</p>" for i in range(4))
    article = "\n".join(f"Paragraph {i} says a lot of things, in a long line, that goes on for a while." for i in range(4))
    comment = "<p>A comment is long, and it says much, quite a lot, of what a reader thinks about this matter. It really does, at length.</p>"
    nav = "<nav>" + "".join(f"<li class=c{i}>item {i}</li>" for i in range(40)) + "</nav>"
    side = "<ul class=sidebar>" + "".join(f"<li class=i{i}>x {i}</li>" for i in range(30)) + "</ul>"
    plain = "".join(f"<div class=t{i}><a href=/{i}>topic {i}</a></div>" for i in range(40))
    for n in (1, 30, 300):
        for menu in (nav, side, plain, ""):
            assert html_extract.main_text(f"<body>{menu}<div id=content>{text}</div><div class=comments>{comment * n}</div></body>") == article
            assert html_extract.main_text(f"<body>{menu}<article>{text}<section class=comments>{comment * n}</section></article></body>") == article
            assert html_extract.main_text(f"<body>{menu}<main><div id=respond>{comment * n}</div><div class=post>{text}</div></main></body>") == article
    short = f"<div class=a><div class=b>{text}</div><div class=c><p class=note>Short one.</p></div></div>"
    assert html_extract.main_text(f"<body>{nav}{short}<footer>end</footer></body>") == f"{article}\nShort one."
    assert html_extract.main_text(f"<body><h1>Title</h1><div class=b>{text}</div><p>By A.</p></body>") == f"Title\n{article}\nBy A."
    assert html_extract.main_text(f"<body><div class=comments>{comment}</div></body>") == comment[3:-4]  # a page of nothing else


def test_html_deep_and_broken_pages_take_linear_time():
    import time

    begun = time.perf_counter()
    for source in ("<div>" * 100_000 + "text", "<div><p>a.</p>" * 50_000, "<b>x" * 100_000, "<a " * 350_000, "<![CDATA[" * 100_000, '<a x="' * 200_001 + '>"', "<" * 1_000_000,
                   "<ul><li>" * 100_000, "</div>" * 100_000 + "<div>" * 100_000 + "</p>" * 100_000, "<!--" * 250_000, "<p><b>" * 100_000 + "</i>" * 100_000):
        html_extract.main_text(source)
    assert time.perf_counter() - begun < 120
    assert html_extract.main_text("<div>" * 100_000 + "text") == "text"


def test_isotonic_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = boosting.fit_boosted(x, y, rounds=30)
    margin = model.margin(x)
    assert ((margin > 0) == (y > 0.5)).mean() > 0.98
    knots = boosting.fit_isotonic(margin, y)
    p = boosting.calibrated(knots, np.sort(margin))
    assert (np.diff(p) >= 0).all() and 0 < p.min() and p.max() < 1


def test_toxicity_held_out(spark, sf):
    sf01 = "/root/testdata/sf0.1"
    found = toxicity.op7_toxicity(spark, sf01).join(table(spark, sf01, "labels"), "doc_id").filter("held_out").collect()
    assert len(found) > 500
    right = sum(r["predicted"] == r["toxic"] for r in found) / len(found)
    assert right >= 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_toxicity_edges(spark, docs_of, hard):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(hard, toxicity.train(hard, labels)).collect()  # one class only
    assert len(found) == hard.count() and {r["predicted"] for r in found} == {0}
    kept = toxicity.drop_toxic(hard, labels)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    assert toxicity.drop_toxic(hard.limit(0), labels).count() == 0
    assert toxicity.words_of("St.u.p.1d l0ser! sooooo b a d x")[1] >= 2


def test_lm_base_and_order(docs_of, hard):
    texts = ["the cat sat on the mat", "the dog sat", None, "The CAT", "zebra quux", ""] * 6
    found = lm_scoring.score_texts(docs_of(texts)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        own = [*words[r["doc_id"]], None]
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-9
        assert r["score"] < 0
    hard_rows = lm_scoring.score_texts(hard).collect()
    assert len(hard_rows) == hard.count() and all(math.isfinite(r["score"]) for r in hard_rows)
    assert lm_scoring.score_texts(hard.limit(0)).count() == 0


def test_lm_words_travel_packed(spark, monkeypatch):
    """Words are shuffled in rows by chunk and part, not in a row each, and each word gets its count of all chunks."""
    monkeypatch.setattr(lm_scoring, "PARTS", 3)
    texts = [" ".join(f"w{i % 7}x{j % (5 + i)}é" for j in range(40)) for i in range(60)] + [None, "", "same " * 9, "word" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows, words = lm_scoring.prepare(docs, lm_scoring.vocabulary_path())
    chunks = rows.select("chunk").distinct().count()
    assert words.count() <= 3 * chunks
    training = [w for r in rows.join(docs, "doc_id").filter("not held_out").collect() for w in (r["text"] or "").split()]
    expected, found, own, fresh = Counter(training), {}, {}, 0
    for r in words.collect():
        at = 0
        for number, n in zip(np.frombuffer(r["numbers"], "<i4"), np.frombuffer(r["lengths"], "<i4"), strict=True):
            own[r["chunk"], number] = r["words"][at : at + n].decode()
            at += n
        assert at == len(r["words"])
    for r in lm_scoring.corpus_counts(words, 5).collect():
        fresh += r["fresh"]
        for number, c in zip(np.frombuffer(r["numbers"], "<i4"), np.frombuffer(r["c"], "<i8"), strict=True):
            found[r["chunk"], number] = c
    assert set(found) == set(own) and all(c == expected[own[x]] for x, c in found.items())
    assert fresh == len(expected)


def test_lm_trains_on_the_end_of_a_sorted_table(spark):
    """A class that comes only after 40,000 windows of the one partition has its weights trained."""
    docs = spark.createDataFrame([(i, "a " * 4800 if i < 600 else "zz " * 480) for i in range(620)], "doc_id long, text string").coalesce(1)
    path = lm_scoring.vocabulary_path()
    vocab = lm_scoring.load(path)
    of = np.ones(vocab.size + 1, dtype=np.int64)
    ids = lambda w: lm_scoring.Encoder(path).encode_words(pa.array([w], pa.large_string()))[0]
    late = np.setdiff1d(ids("zz"), ids("a"))
    of[late], of[vocab.size] = 2, 0
    direct = attention_lm.direct_tables(np.ones((attention_lm.CLASSES,) * 2))
    texts, _ = lm_scoring.prepare(docs, path)
    weights = lm_scoring.train(texts.filter("not held_out").select("ids"), of, direct, "<u2")
    start = attention_lm.new_params()
    assert len(late) and (weights["k"][1] != start["k"][1]).any() and (weights["k"][2] != start["k"][2]).any()


def test_lm_every_window_is_trained_on_once(spark, monkeypatch):
    """Over all rounds the trainer sees each window of each training text once, whatever the batches."""
    texts = [" ".join(f"w{i}x{j}" for j in range(3 + 17 * i)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = lm_scoring.vocabulary_path()
    prepared, _ = lm_scoring.prepare(docs, path)
    training = prepared.filter("not held_out").select("ids")
    of = np.arange(lm_scoring.load(path).size + 1) % 1000
    batches = [b for r in training.collect() for b in [pa.RecordBatch.from_arrays([pa.array([r["ids"]], pa.binary())], names=["ids"])]]
    seen = []

    class Recorder:
        def __init__(self, start, direct, seed):
            self.p = start

        def see(self, c, y):
            seen.extend(map(tuple, c.tolist()))

    class One:
        """A DataFrame of one partition, run here."""

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(attention_lm, "Trainer", Recorder)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(lm_scoring, "_met", lambda run, add, schema: [dict(zip(("n", "flat"), (x.as_py() for x in b.columns[0:0] or (b.column(0)[0], b.column(1)[0])), strict=True)) for b in run(iter(batches))])
    lm_scoring.train(One(), of, {}, "<u2")
    expected = []
    for b in batches:
        ids, sizes = lm_scoring._numbers(b.column(0), "<u2")
        expected.extend(map(tuple, attention_lm.windows(of[ids], sizes)[0].tolist()))
    assert sorted(seen) == sorted(expected) and len(seen) > 100


def test_lm_score_by_brute_force(spark, docs_of):
    """A text's score token by token, from the fitted tables alone."""
    texts = ["the cat sat on the mat", "the dog sat on a log and the cat sat too", None, "zebra quux " * 30, "The CAT"] * 8
    path = lm_scoring.vocabulary_path()
    prepared, _ = lm_scoring.prepare(docs_of(texts), path)
    fitted = lm_scoring.fit(prepared, path)
    p, direct = fitted.weights, fitted.direct
    encoder = lm_scoring.Encoder(path)
    for text in texts[:5]:
        words = [encoder.encode_words(pa.array([w], pa.large_string()))[0].tolist() for w in (text or "").lower().split()]
        ids = [i for w in words for i in w] + [encoder.vocab.size]
        classes = [int(fitted.of[i]) for i in ids]
        total = 0.0
        for n, (i, goal) in enumerate(zip(ids, classes, strict=True)):
            # Inputs of the window up to this token: the class before each place.
            window_start = n // attention_lm.STEP * attention_lm.STEP - attention_lm.CONTEXT
            before = [classes[x - 1] if x >= 1 else attention_lm.START for x in range(window_start, n + 1)]
            place = n - window_start
            q = p["q"][before[-1]] + p["pq"][place]
            a = [math.exp(float(q @ (p["k"][c] + p["pk"][x])) / 4) for x, c in enumerate(before)]
            o = sum(w * p["v"][c].astype(float) for w, c in zip(a, before, strict=True)) / sum(a)
            g, inner = divmod(goal, attention_lm.SIDE)
            for z, at in ((direct["group"][before[-1]] + o @ p["wg"] + p["bg"], g), (direct["inner"][before[-1], g] + o @ p["wi"][g], inner)):
                total += z[at] - math.log(np.exp(z.astype(float)).sum())
            total += float(fitted.in_class[i])
        found = fitted.log10_probs(np.array(ids), np.array([len(ids)]))[0]
        assert abs(found - total / math.log(10)) < 1e-3 * abs(found)


def test_lm_held_out(spark):
    """On held-out documents the model is better than word counts."""
    got = lm_scoring.op8_lm_scoring(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.1


def test_lm_is_a_distribution():
    """Class probabilities after any context add up to one."""
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 50, (attention_lm.CLASSES, attention_lm.CLASSES)).astype(float)
    direct = attention_lm.direct_tables(pairs)
    p = attention_lm.new_params()
    context = rng.integers(0, attention_lm.CLASSES, (1, attention_lm.LENGTH))
    targets = np.full((attention_lm.CLASSES, attention_lm.STEP), -1)
    targets[:, 5] = np.arange(attention_lm.CLASSES)
    log_p = attention_lm.log_probs(p, direct, np.repeat(context, attention_lm.CLASSES, axis=0), targets)[:, 5]
    assert abs(np.exp(log_p.astype(np.float64)).sum() - 1) < 1e-3


def test_lm_gradients():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 5, (attention_lm.CLASSES, attention_lm.CLASSES)).astype(float)
    direct = attention_lm.direct_tables(pairs)
    p = {k: v.astype(np.float64) for k, v in attention_lm.new_params().items()}
    c = rng.integers(0, attention_lm.CLASSES, (4, attention_lm.LENGTH))
    y = rng.integers(-1, attention_lm.CLASSES, (4, attention_lm.STEP))
    loss = lambda: -attention_lm.log_probs({k: v.astype(np.float32) for k, v in p.items()}, direct, c, y).sum(dtype=np.float64) / (y >= 0).sum()
    grads = attention_lm.gradients({k: v.astype(np.float32) for k, v in p.items()}, direct, c, y)
    for name in p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = p[name][at]
        p[name][at] = old + 0.01
        up = loss()
        p[name][at] = old - 0.01
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 0.02 - grads[name][at]) < 0.15 * abs(grads[name][at]) + 2e-3, name


def test_lm_windows_score_each_token_once():
    sizes = np.array([1, 24, 25, 100])
    classes = np.arange(sizes.sum())
    inputs, targets, _ = attention_lm.windows(classes, sizes)
    assert sorted(targets[targets >= 0]) == classes.tolist()
    for row, goal in zip(inputs, targets, strict=True):
        for j in range(1, attention_lm.STEP):
            if goal[j] >= 0 and goal[j - 1] >= 0:
                assert row[attention_lm.CONTEXT + j] == goal[j - 1]


def test_lm_learns():
    rng = np.random.default_rng(4)
    sizes = np.full(300, 48)
    language = rng.integers(0, 2, 300)  # two vocabularies; the one of the text so far tells which comes
    classes = (rng.integers(0, 5, (300, 48)) + language[:, None] * 100).ravel()
    counts = np.bincount(classes, minlength=attention_lm.CLASSES).astype(float)
    direct = attention_lm.direct_tables(np.tile(counts, (attention_lm.CLASSES, 1)))
    inputs, targets, _ = attention_lm.windows(classes, sizes)
    start = attention_lm.new_params()
    before = attention_lm.log_probs(start, direct, inputs, targets).sum()
    trainer = attention_lm.Trainer(start, direct)
    for _ in range(17):
        trainer.see(inputs, targets)
    after = attention_lm.log_probs(trainer.p, direct, inputs, targets).sum()
    assert after > 0.85 * before


def test_registry_names():
    assert sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) == [
        "op1_chat", "op2_simhash", "op3_packing", "op4_url_filter", "op5_exact_dedup", "op6_media", "op7_toxicity", "op8_lm_scoring", "op9_bpe", "op10_html",
        "op11_divergence", "op12_vector_codes", "op13_sharding"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(HARD) == 16
