import math
import random
from collections import Counter

import numpy as np

from marlpit.llm.language_id import EVIDENCE_ALPHA, PRIOR_ALPHA, fit_text, identify, page_text, trigrams

rng = random.Random(13)
PARTS = {"de": ["ung", "sch", "ein", "und", "ich"], "en": ["the", "ing", "ion", "and", "ough"], "fr": ["eau", "ent", "que", "les", "tion"]}


def text(lang, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(2)) for _ in range(n))


def page(lang, n):
    return f'<html lang="{lang}"><head><title>{text("en", 3)}</title></head><body><nav>{text("fr", 9)}</nav><div class="ad">{text("de", 5)}</div><article><p>{text(lang, n)}</article></body></html>'


def test_page_text():
    assert page_text("<html><script>x</script><nav>n</nav><article><p>a &amp; <b>b</article> c") == "a & b"
    assert page_text("<p>one<br>two<style>x") == "one two" and page_text("") == "" and page_text("<<>><") == "><"
    assert len(trigrams("")) == 0 and len(trigrams("a")) == 1


def test_page_text_is_whole():
    assert page_text("<article>a</article><p>x<article class='y'>b</article><main>c</main>") == "a b c"
    assert page_text("<main>a<article>b</article>c<article>d<article>e</article>f</article>g</main>h") == "a b c d e f g"
    assert page_text("<article></article><p>a") == "a" and page_text("<article> <b></b></article><nav>n</nav>a") == "a"
    for tag in ("nav", "header", "footer", "aside", "noscript", "template", "title"):
        assert page_text(f"a<{tag} class='x'>b<article>c</article><p>d") == "c" and page_text(f"a<{tag}>b") == "a b"
    assert page_text("a<!-- b") == "a b" and page_text('a<div class="ad">b<p>c') == "a b c"
    assert page_text("<nav>n</nav>a<!-- x -->b<nav>c") == "a b c"
    assert page_text("<main>" * 3 + "a" + "<nav>" * 100_000 + "b") == "a b"


def test_fusion_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, text(x), x) for x in PARTS for k in range(30)] + [(1, None, "en"), (2, "xx", None)], "doc_id long, text string, lang string")
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(PARTS))
        rows.append((i, f"https://{rng.choice(['a', 'b'])}.{lang}site.{rng.choice(['com', lang])}/x?y", page(lang, rng.choice([0, 1, 30]))))
    rows += [(3, None, None), (None, "no address", ""), (500, "http://a.desite.de/", "<html lang='xx'>"), (501, "http://a.desite.de:80/", page("de", 1))] + [rows[5]] * 2
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, lang string")
    got = identify(pages, docs).collect()
    assert len(got) == len(rows)
    model = fit_text(docs)
    names = model.languages
    assert names == ["de", "en", "fr"]
    info = []
    for i, url, markup in rows:
        logs = model.log_likelihoods(page_text(markup or ""))
        host = (url or "").split("//")[1].split("/")[0].split(":")[0] if "//" in (url or "") else ""
        declared = next((x for x in names if f'lang="{x}"' in (markup or "")), "other")
        info.append((i, logs, None if logs.max() == logs.min() else names[int(logs.argmax())], declared, host.rpartition(".")[2] if "." in host else "", ".".join(host.split(".")[-2:]), host))
    count = {k: Counter((row[k], row[2]) for row in info) for k in range(3, 7)}
    totals = Counter(row[2] for row in info if row[2])
    want = []
    for i, logs, said, declared, suffix, domain, host in info:
        scores = []
        for at, x in enumerate(names):
            seen = lambda k, v: count[k][(v, x)] - (said == x)  # noqa: B023, E731
            size = lambda k, v: sum(count[k][(v, y)] for y in names) - (said is not None)  # noqa: B023, E731
            base = (totals[x] + 1) / (sum(totals.values()) + 3)
            inner = (seen(5, domain) + PRIOR_ALPHA * base) / (size(5, domain) + PRIOR_ALPHA)
            prior = (seen(6, host) + PRIOR_ALPHA * inner) / (size(6, host) + PRIOR_ALPHA)
            evidence = [(count[k][(v, x)] + EVIDENCE_ALPHA) / (totals[x] + EVIDENCE_ALPHA * len({r[k] for r in info})) for k, v in ((3, declared), (4, suffix))]
            scores.append(logs[at] + math.log(evidence[0]) + math.log(evidence[1]) + math.log(prior))
        scores = np.array(scores)
        want.append((i, names[int(scores.argmax())], round(float(1 / np.exp(scores - scores.max()).sum()), 9), said))
    assert sorted(map(str, ((r.page_id, r.lang, round(r.confidence, 9), r.text_lang) for r in got))) == sorted(map(str, want))
    assert sum(r.lang == "de" for r in got if r.page_id in (500, 501)) == 2
    assert identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in identify(pages, docs.limit(0)).collect()} == {None}
