"""Licence scans against a plain search that ranks by zstandard alone, and the time of dense text."""

import random
import re
import time

import pytest
import zstandard

from daftar.llm import license_scan as L
from daftar.llm.license_templates import TEMPLATES

PROSE = "the river was low and every boat lay on sand until rain came over hills again in march".split()


def _common(a, b):
    """A longest common sequence by a plain table, as pairs of places; the last possible ones."""
    held = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            held[i + 1][j + 1] = held[i][j] + 1 if x == y else max(held[i][j + 1], held[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if held[i][j - 1] == held[i][j]:
            j -= 1
        elif held[i - 1][j] == held[i][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _size(text, template=None):
    data = " ".join(text.split()).lower().encode()
    if template is None:
        return len(zstandard.ZstdCompressor(level=6, write_content_size=False).compress(data))
    raw = "\n".join(" ".join(p.split()) for p in template.passages).lower().encode()
    content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=6)
    return len(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False).compress(data))


def _apart(ranked):
    taken = []
    for x in ranked:
        if all(x[1] <= a or x[0] >= b for a, b, *_ in taken):
            taken.append(x)
    return taken


def _plain(text):
    """Every passage of every template from every word on; ranked by bytes saved, without blocks or shortcuts."""
    places = [m.span() for m in re.finditer("[A-Za-z0-9]+", text)]
    words = [text[a:b].lower() for a, b in places]
    ranked = []
    for k, t in enumerate(TEMPLATES):
        found = set()
        for p in t.passages:
            own = [w.lower() for w in re.findall("[A-Za-z0-9]+", p)]
            least = next(n for n in range(len(own) + 1) if n >= L.SHARE * len(own))
            span = int(len(own) + 2 + L.EXTRA * len(own))
            for s in range(len(words)):
                here = words[s : s + span]
                if words[s] not in own or sum(w in own for w in here) < least:
                    continue
                pairs = _common(here, own)
                got = iter([own[j] for _, j in pairs])
                if len(pairs) < least or not all(any(w == x for x in got) for w in t.needs):
                    continue
                first, last = s + pairs[0][0], s + pairs[-1][0]
                extra = last + 1 - first - len(pairs)
                if extra <= 2 + L.EXTRA * len(own):
                    found.add((first, last + 1, len(own) - len(pairs) + extra, len(pairs)))
        for first, end, wrong, _ in _apart(sorted(found, key=lambda x: (2 * x[2] - x[3], x[0], x[1]))):
            a, b = places[first][0], places[end - 1][1]
            plain, saved = _size(text[a:b]), _size(text[a:b]) - _size(text[a:b], t)
            if saved >= L.LEAST * plain:
                ranked.append((a, b, -saved, wrong, k))
    return sorted((a, b, TEMPLATES[k].spdx) for a, b, _, _, k in _apart(sorted(ranked, key=lambda x: (*x[2:], *x[:2]))))


def _texts():
    rng = random.Random(12)
    passages = [p for t in TEMPLATES for p in t.passages]
    for i in range(70):
        parts = []
        for p in rng.sample(passages, rng.choice([1, 1, 2, 3])):
            words = p.split()
            for _ in range(rng.choice([0, 0, 1, 2]) if len(words) > 12 else 0):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(PROSE)]
            parts += rng.choices(PROSE, k=rng.randrange(25)) + words
        yield i, rng.choice([" ", "\n# ", " "]).join(parts + rng.choices(PROSE, k=rng.randrange(25)))


def test_passages_equal_a_plain_search(spark):
    texts = dict(_texts())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: [(x.start, x.end, x.spdx) for x in r.found] for r in L.scan(frame.withColumnRenamed("doc_id", "id"), "id").collect()}
    want = {i: _plain(t) for i, t in texts.items()}
    assert sum(map(len, want.values())) > 80
    assert got == want


def test_compression_decides_between_kin():
    """Wordings that more than one template confirms; the one that saves most is named."""
    scanner = L.Scanner()
    decided = 0
    for t in TEMPLATES:
        for p in t.passages:
            words = [w.lower() for w in re.findall("[A-Za-z0-9]+", p)]
            found = scanner.confirmed(words)
            decided += len({k for k, *_ in found}) > 1
            assert [x[2] for x in scanner.scan(p)[1]] == [t.spdx], p
    assert decided >= 5


@pytest.mark.parametrize("source", ["MIT", "all"])
def test_time_of_dense_text_is_linear(source):
    scanner = L.Scanner()
    text = "\n".join(p for t in TEMPLATES for p in t.passages if source == "all" or (t.spdx == source and len(p) > 150)) + "\n"

    def took(size):
        whole = text * (size // len(text))
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            found = scanner.scan(whole)[1]
            best = min(best, time.process_time() - began)
        assert len(found) >= whole.count(text)
        return best

    took(20_000)
    assert took(160_000) < 2.8 * took(80_000)  # twice the text; the rest is for a busy machine
