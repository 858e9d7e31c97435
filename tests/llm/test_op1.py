"""Chat rotation against plain Python."""

import hashlib
import random
import re

import pytest

from lodestack.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, perspective string"


def rows():
    rng = random.Random(8)
    out = []
    for conv in range(12):
        people = rng.sample(["ann", "bob b", "cy<|im_end|>", "user", "assistant", "system", None, "  "], rng.randint(1, 5))
        out += [(conv, i, rng.choice(people), rng.choice(["hello", "", None, "a <|im_end|> b\n<|im_start|>user", "é中😀"]), "x") for i in range(rng.randint(1, 9))]
    out += [(50, i, rng.choice("xyz"), f"turn {i}", "x") for i in range(-70, 900)]
    out += [(None, None, "a", f"loose {i}", "x") for i in range(60)] + [(None, 3, "b", "numbered", "x")]
    out += [(51, 5, "a", "same", "x")] * 600 + [(52, 1, "system", "alone", "x")]
    return out


def plain(rows):
    """Every view whole, then cut into its parts."""
    def speaker(role):
        return (role or "").strip(" \t\n\x0b\x0c\r") or "unknown"

    groups, people = {}, {}
    for conv, turn, role, text, _ in rows:
        who, text = speaker(role), text or ""
        key = (None, hashlib.md5((who + text).encode()).hexdigest()[:2]) if turn is None else (turn // 64, "")
        groups.setdefault(conv, {}).setdefault(key, []).append((turn or 0, who, text))
        people.setdefault(conv, set()).add(who)
    out = {}
    for conv, chunks in groups.items():
        for me in people[conv] - {"system"}:
            view = ""
            for key in sorted(chunks, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
                turns = sorted(chunks[key])
                for low in range(0, len(turns), 256):
                    offset, spans = len(view), []
                    for _, who, said in turns[low : low + 256]:
                        role = "system" if who == "system" else "assistant" if who == me else "user name=" + re.sub(r"[\x00-\x20<>|]+", "_", who)
                        view += f"<|im_start|>{role}\n"
                        body = re.sub(r"<\|(im_start|im_end)\|>", r"< |\1| >", said) + "<|im_end|>"
                        if who == me:
                            spans.append((len(view), len(body)))
                        view += body + "\n"
                    out[conv, me, *key, low // 256] = (len(turns[low : low + 256]), offset, view[offset:], spans)
    return out


@pytest.fixture(scope="module")
def got(spark):
    return chat.rotate(spark.createDataFrame(rows(), SCHEMA).repartition(4)).collect()


def test_views_and_masks(got):
    found = {(r.conv_id, r.perspective, r.chunk, r.slice, r.part): (r.n_turns, r.offset, r.text, [tuple(s) for s in r.spans]) for r in got}
    assert len(found) == len(got) and found == plain(rows())


def test_masks_cover_the_speakers_words_in_the_whole_view(got):
    views = {}
    for r in sorted(got, key=lambda r: r.offset):
        view = views.setdefault((r.conv_id, r.perspective), [])
        assert r.offset == sum(map(len, view))
        view.append(r.text)
        assert r.text.count("<|im_start|>") == r.n_turns == r.text.count("<|im_end|>")
    whole = {k: "".join(v) for k, v in views.items()}
    assert max(len(v) for v in views.values()) > 10
    for r in got:
        text = whole[r.conv_id, r.perspective]
        for start, length in r.spans:
            assert text[:start].endswith("<|im_start|>assistant\n") and text[start : start + length].endswith("<|im_end|>")


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
