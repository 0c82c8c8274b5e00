"""Page summaries against plain Python over all pairs of sentences."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from barloom.functions.text import STOP
from barloom.queries.texts import summaries


def plain_summary(text: str) -> str:
    """Words count as often as both sentences have them; sentences end before a capital or digit and have more than 20 characters."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if len(s) > 20]
    if len(sentences) < 2:
        return text
    bags = [Counter(w for w in re.findall("[a-z']{3,}", s.lower()) if w not in STOP) for s in sentences]
    n = [sum(b.values()) for b in bags]

    def alike(i: int, j: int) -> float:
        common = sum((bags[i] & bags[j]).values())
        return common / (math.log(1 + n[i]) + math.log(1 + n[j])) if common else 0.0

    score = [round(math.fsum(alike(i, j) for j in range(len(bags)) if j != i), 6) for i in range(len(bags))]
    return " ".join(sentences[i] for i in sorted(sorted(range(len(bags)), key=lambda i: (-score[i], i))[:2]))


def test_summaries_of_long_pages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 12))).capitalize() + rng.choice(".!?")
    texts = [" ".join(sentence() for _ in range(n)) for n in (1, 2, 3, 39, 40, 41, 60, 300)]
    texts += [" ".join(["Gold and gold and gold are the first of all."] * 2), "Short. Too short. 7 is a digit that begins this sentence. no capital here. And one that has none of them."]
    texts += [" ".join(f"Only{chr(97 + i // 8)}{chr(97 + i % 8)} word{chr(97 + i // 8)}{chr(97 + i % 8)} stands{chr(97 + i // 8)}{chr(97 + i % 8)}." for i in range(45)) + " Shared words close the page here. Shared words close the page."]
    pages = [(i, f"<p>{t}</p>") for i, t in enumerate(texts)] + [(100, None), (101, "")]
    got = {r["page_id"]: r["summary"] for r in summaries(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {i: plain_summary(t) for i, t in enumerate(texts)} | {100: "", 101: ""}
    assert got[10] == "Shared words close the page here. Shared words close the page."
