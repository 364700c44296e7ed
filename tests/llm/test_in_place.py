"""Operators that read documents where they are: extraction, secrets, quality, token counts, language."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataheal.llm import html, language, quality, secrets, tokencounts

from .conftest import prose, texts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- HTML extraction

def test_blocks_of_broken_pages():
    found = html.blocks("<DIV class='a b'>x &amp;\n y<br>z<p>one<p>two</DIV><script>if (a<b) '</p>'</script><style>q</style><!-- c --><b>tail < end")
    assert [b.text for b in found] == ["x & y z", "one", "two", "tail < end"]
    assert found[0].path == ("div", ".a", ".b") and found[-1].path == ()
    assert html.blocks("") == [] and html.blocks("<p></p>  <br>") == []
    assert html.blocks("&lt;p&gt; &nbsp; x")[0].text == "<p> x"


def test_labeller_gradient():
    pages = html.training_pages(2, 1)
    net = html.Labeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        x, sizes = net.padded([p for p, _ in pages])
        z, total = net.logits(net.run(x)[0], sizes), 0.0
        for i, (_, y) in enumerate(pages):
            total += (np.logaddexp(0, z[: len(y), i]) - y * z[: len(y), i]).sum()
        return total / sizes.sum()

    for name, g in net.gradient(pages).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = net.w[name][at], 1e-2
        net.w[name][at] = was + step
        up = loss()
        net.w[name][at] = was - step
        down = loss()
        net.w[name][at] = was
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.02), name


def test_held_out_pages_and_table(spark):
    net = html.trained()
    held = html.training_pages(150, 991)
    wrong = sum(int(((p >= 0.5) != (y >= 0.5)).sum()) for p, (_, y) in zip(net.label([p for p, _ in held]), held))
    assert wrong / sum(len(y) for _, y in held) < 0.015
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.entities.unescape(x).split()) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", article.replace("<br>", " ")))]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in want if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_long_and_deep_pages_stay_small():
    """One page of 150,000 blocks among short ones, 100,000 nested elements, and tags that never end."""
    import tracemalloc

    net = html.trained()
    short = [html.training_page(random.Random(k))[0] for k in range(40)]
    long = "<body><article>" + "".join(f"<p>Sentence {i} of a long page.</p>" for i in range(150_000))
    alone = html.main_texts(short, net)
    tracemalloc.start()
    together = html.main_texts([short[0], long, *short[1:]], net)
    deep = html.main_texts(["<div>x" * 100_000, "<div>" * 50_000 + "</p>x" * 50_000, "<x " * 200_000, '<a href="' * 50_000], net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [together[0], *together[2:]] == alone and len(deep) == 4
    assert together[1].count("\n") > 140_000
    assert peak < 1 << 30


def test_elements_along_a_path_give_the_mean_of_its_parts():
    net, paths, known = html.Labeller(), html.Slots(html.path_slots), html.Slots(html.word_slot)
    found = [b for k in range(30) for b in html.blocks(html.training_page(random.Random(k))[0])] + html.blocks("text before <p>any")
    listed, shared = html.Page(found, paths, known), html.Page(found, None, known)
    assert np.allclose(net.vectors([listed]), net.vectors([shared], {}), atol=1e-5)


def test_lists_figures_and_bare_comment_headings():
    page = (
        "<html><body><nav><a href=/>Home</a></nav><article class=post><h1>A title of words</h1><p>Some prose stands here, with a few words. And more.</p>"
        "<dl><dt>Term</dt><dd>What the term means in some words.</dd></dl><figure><img src=x><figcaption>A caption of the picture.</figcaption></figure>"
        "<p>More prose at the end of it.</p></article><section><h2>Comments</h2><div class=comment><h4>ann says:</h4><p>I liked this text a lot.</p></div>"
        "<div class=comment><p>Me too, thanks.</p></div></section><footer><p>Copyright</p></footer></body></html>")
    assert html.main_texts([page], html.trained()) == [
        "A title of words\nSome prose stands here, with a few words. And more.\nTerm\nWhat the term means in some words.\nA caption of the picture.\nMore prose at the end of it."]


def test_awkward_pages(spark):
    page = "<article><h1>Title</h1><p>" + prose(5, 40) + ".</p></article>"
    long = "<article>" + "".join(f"<p>{prose(i, 30)}.</p>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame(
        [(1, "u", None, "z"), (2, None, "", "z"), (None, "u", page, "z"), (3, "u", page, "z"), (3, "u", page, "z"), (4, "u", long, "z")],
        "page_id long, url string, html string, text string")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r[0], r[1]): (r[2], r[3]) for r in got.collect()}
    assert found[1, "u"] == ("", 0) and found[2, None] == ("", 0)
    assert found[None, "u"] == found[3, "u"] and found[3, "u"][0] == "Title\n" + prose(5, 40) + "."
    assert found[4, "u"][0].count("\n") == 2999 and got.count() == 6
    assert html.extract(df.limit(0)).count() == 0


# --- secrets

def base_by_hand(text: str) -> list[str]:
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x for *_, x in sorted(found)]


def test_secret_scan(documents, nothing):
    got = secrets.scan(documents)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r["doc_id"], r)
    for doc, text, _ in texts():
        want = base_by_hand(text or "")
        r = by_text[doc]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign:", "access:", "hex:"))
        assert set(want) <= set(r["spans"].split(","))
    assert got.count() == len(texts()) and secrets.scan(nothing).count() == 0


def test_base_patterns():
    r = random.Random(3)
    parts = ("token", "Token", "api_key", " = ", ":", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123", "é", " ", "x" * 12, "=", "ſecret", "passwd")
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(secrets.base_spans(text))] == base_by_hand(text), text


def test_field_on_held_out_lines():
    field, right = secrets.trained(), 0
    lines = secrets.training_lines(600, seed=77)
    for line, secret in lines:
        right += [line[a:b] for a, _, b in secrets.field_spans(line, field)] == secret
    assert right / len(lines) > 0.97


def test_viterbi_is_the_best_path():
    from itertools import product

    field, r = secrets.Field(), np.random.default_rng(1)
    field.emit, field.move = r.normal(size=field.emit.shape), r.normal(size=(3, 3))
    for n in (1, 2, 5):
        chain = r.integers(0, len(field.emit), (n, len(secrets.WIDTHS)))

        def score(path):
            s = field.start[path[0]] + field.emit[chain[0], path[0]].sum()
            return s + sum(field.move[a, b] + field.ban[a, b] + field.emit[chain[i + 1], b].sum() for i, (a, b) in enumerate(zip(path, path[1:])))

        assert field.decode(chain) == list(max(product(range(3), repeat=n), key=score))


def test_redact(documents):
    before, after = documents.collect(), secrets.redact(documents).collect()
    assert secrets.redact(documents).columns == documents.columns
    for a, b in zip(before, after):
        if a["doc_id"] == 10:
            assert b["text"] == "config [SECRET] and more words after it".replace("[SECRET] and", '[SECRET]" and') and b["n_chars"] == len(b["text"])
        else:
            assert tuple(a) == tuple(b)


def test_secrets_that_reach_beyond_a_base_span(spark):
    """Keys of several lines after an assignment, and tokens that go on after a base pattern, are redacted whole."""
    r, field = random.Random(6), secrets.trained()
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    lines = ["".join(r.choice(chars) for _ in range(64)) for _ in range(4)]
    cases = [
        ("the secret=" + "\n".join(lines) + "\nand more words", lines),
        ("the api_key: " + " ".join(lines[:3]) + " and more words", lines[:3]),
        (f"the token = {lines[0][:20]}~{lines[1][:20]} and more words", [lines[1][:20]]),
        (f"the key Zq{lines[0][:9]}0123456789abcdef{lines[1][:9]}Q and more words", [lines[1][:9]]),
    ]
    for text, parts in cases:
        base, spans = secrets.all_spans(text, field)
        assert base and set(base) <= set(spans)
        for p in parts:
            assert any(a <= text.index(p) and text.index(p) + len(p) <= b for a, _, b in spans), (text, spans)
    docs = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars int")
    for row in secrets.redact(docs).collect():
        assert not any(p in row["text"] for p in cases[row["doc_id"]][1]) and row["text"].endswith(" and more words".replace(" ", "\n" if not row["doc_id"] else " ", 1))
        assert row["n_chars"] == len(row["text"])


# --- quality

def test_counts_against_plain_python(documents):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.statistics(documents).collect()}
    for doc, text, _ in texts():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc, len(words)]
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})


def test_repeat_words_random():
    r = random.Random(1)
    for _ in range(500):
        words = [r.choice("ab") for _ in range(r.randint(0, 12))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        want = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality.repeat_words(quality.common.word_hashes([w.encode() for w in words])) == len(want), words


def test_estimate_finds_accuracies():
    r = np.random.default_rng(4)
    good = r.random(20_000) < 0.85
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    votes = np.where(r.random((len(good), 5)) < 0.2, 0, np.where(r.random((len(good), 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, p_good, p_bad = quality.estimate(patterns, counts.astype(float))
    assert prior == pytest.approx(0.85, abs=0.03)
    assert p_good[:, 2] / (p_good[:, 0] + p_good[:, 2]) == pytest.approx(right, abs=0.03)
    assert np.mean((quality.posterior(votes, prior, p_good, p_bad) > 0.5) == good) > 0.97


def test_quality_on_labels(spark, nothing, documents):
    sf = "/root/testdata/sf0.01"
    judged = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    assert judged.where(F.col("kept") != (F.col("quality") == 1)).count() <= 0.01 * judged.count()
    assert quality.judge(nothing).count() == 0
    odd = quality.judge(documents)
    assert odd.count() == len(texts()) and odd.where("doc_id in (1, 2, 3) and (kept or not base_failed)").count() == 0


# --- token counts

def greedy(word: str, pieces: set[str]) -> int:
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_is_longest_match():
    r = random.Random(2)
    for _ in range(1500):
        pieces = ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))] + r.sample(["a", "b"], r.randint(0, 2))
        automaton = tokencounts.Automaton(pieces)
        for _ in range(8):
            word = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == greedy(word, set(pieces)), (pieces, word)


def test_token_counts(documents, nothing):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, letters = set(tokencounts.vocabulary(path)), tokencounts.byte_letters()
    got = rows(tokencounts.count(documents, path))
    want = []
    for doc, text, _ in texts():
        words = (text or "").encode().lower().split()
        want.append((doc, len(words), sum(greedy("".join(map(letters.get, w)) + tokencounts.STOP, pieces) for w in words)))
    assert got == sorted(want, key=repr) and tokencounts.count(nothing, path).count() == 0


def parts_by_hand(word: str) -> list[str]:
    """Letter runs, single digits, runs of other characters and short English endings."""
    kind = lambda c: {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "_" if c.isspace() else "M")
    out, at = [], 0
    while at < len(word):
        ending = next((e for e in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if word.startswith(e, at)), None)
        end = at + 1
        while not ending and kind(word[at]) in "LM" and end < len(word) and kind(word[end]) == kind(word[at]):
            end += 1
        out += [ending or word[at:end]] if ending or kind(word[at]) != "_" else []
        at = at + len(ending) if ending else end
    return out


def test_texts_without_spaces_are_counted_whole(spark, tmp_path):
    """Greedy matching by hand, part by part; the end mark costs nothing where no piece ends the part."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, letters, r = set(tokencounts.vocabulary(path)), tokencounts.byte_letters(), random.Random(12)
    longest = max(map(len, pieces))

    def pieces_of(part):
        left, n = "".join(map(letters.get, part.encode())) + tokencounts.STOP, 0
        while left and left != tokencounts.STOP:
            left = left[next(k for k in range(min(longest, len(left)), 0, -1) if left[:k] in pieces) :]
            n += 1
        return n

    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    cases = [
        "快速的棕色狐狸跳过了懒狗。" * 20, "いろはにほへとちりぬるを、わかよたれそつねならむ" * 20, "".join(r.choice(chars) for _ in range(3000)),
        "function(a,b){return a.b[0]+b['x12']||it's.they're;}" * 30, "thre anan inhe", "a\u00a0b c²½e\u0301", None, "", "x" * 500, "don't \U0001f600!!",
    ]
    docs = [(i, t) for i, t in enumerate(cases)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in docs:
        words = (t or "").encode().lower().split()
        want.append((i, len(words), sum(pieces_of(p) for w in words for p in parts_by_hand(w.decode()))))
    assert rows(tokencounts.query(spark, str(tmp_path))) == want
    assert all(n > 100 for _, _, n in want[:4]) and want[4][2] >= 3


# --- language

def test_filters_return_all_languages():
    r = np.random.default_rng(0)
    profiles = {f"l{i:02d}": r.integers(1, 2**63, 500, dtype=np.uint64) for i in range(70)}
    shared = next(iter(profiles.values()))[:10]
    profiles["l69"] = np.concatenate([profiles["l69"], shared])
    filters = language.Filters.build(profiles)
    assert filters.counts(shared)[0] == pytest.approx(10, abs=0.1) and filters.counts(shared)[69] == pytest.approx(10, abs=0.1)
    noise = r.integers(1, 2**63, 20_000, dtype=np.uint64)
    assert filters.counts(noise).max() < 0.01 * len(noise)


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = language.query(spark, sf)
    truth = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert truth.where("lang = lang_pred").count() >= 0.97 * truth.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_number_signs_are_no_letters(spark):
    filters = language.Filters.build({"aa": np.unique(language.grams("some words to know")), "bb": np.unique(language.grams("andere dinge"))})
    texts_ = ["½ ² Ⅷ", "①", "12 _ 3", "ª", "漢", "x"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, filters).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, False, False, False]


def test_awkward_languages(documents, nothing):
    filters = language.learn(documents.select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r["doc_id"]: r for r in language.identify(documents, filters).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 16))
    assert got[7]["lang_pred"] == "de" and got[4]["lang_pred"] == "en" and got[17]["lang_pred"] in ("de", "en", "fr")
    assert language.identify(nothing, filters).count() == 0
    empty = language.learn(nothing.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r["lang_pred"] for r in language.identify(documents, empty).collect()} == {"und"}
    kept = language.keep(documents, filters)
    assert kept.columns == documents.columns and not {1, 2, 3, 16} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == len(texts()) - 4


def test_foreign_texts_are_left_out(spark):
    """Texts of languages nobody taught go, long or short; few of the taught ones do."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(9)
    italian = "La casa era vecchia e nessuno ci abitava da anni, ma ogni sera qualcuno accendeva una luce alla finestra della cucina. "
    foreign = {
        -1: italian + "I ragazzi del paese raccontavano che fosse il fantasma del mugnaio, gli anziani invece scuotevano la testa senza parlare. " * 3,
        -2: "Stary dom stał pusty od wielu lat, ale każdego wieczoru ktoś zapalał światło w oknie kuchni, a dzieci mówiły o duchu młynarza. " * 3,
        -3: "Vanha talo oli ollut tyhjillään vuosia, mutta joka ilta joku sytytti valon keittiön ikkunaan, ja lapset puhuivat myllärin haamusta. " * 3,
        -4: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(900)),
        -5: "Быстрая лиса прыгает.",
    }
    more = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in foreign.items()], docs.schema)
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs.union(more), "").select("doc_id").collect()}
    assert not kept & set(foreign)
    taught = {x["doc_id"] for x in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert len(taught - kept) <= 0.005 * len(taught)


def test_upper_bound_narrows():
    bounds = [language.upper(0.2, n) for n in (1, 10, 100, 1000, 100_000)]
    assert bounds == sorted(bounds, reverse=True) and bounds[0] > 0.9 and bounds[-1] < 0.22 and language.upper(1.0, 5) == pytest.approx(1)
