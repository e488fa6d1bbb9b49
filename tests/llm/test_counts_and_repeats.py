import random

import public_tokenizers
from tokenizers import Tokenizer

from daybook.llm.repetition import RepetitionRules, repetition_measures, repetition_verdicts
from daybook.llm.token_counts import count_message_tokens, count_tokens, load_merges
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def noise(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library(bodies):
    texts = [*ODD, *noise(1, 400, [*"aaabt he's 're\n\n\t  \x1c\x85é漢字😀ß12!?.<|>\x00",
                                   "<|endoftext|>", "the ", "​", "\r\n", "　"])]
    reference = Tokenizer.from_file(PATH)
    want = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
    n_bytes, n_tokens = count_tokens([t or "" for t in texts], load_merges(PATH))
    assert n_tokens.tolist() == want
    rows = {r["rowid"]: r for r in count_message_tokens(bodies(*texts), PATH, 10).collect()}
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == want
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode())
                                                               for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in rows.values())


def plain_measures(text, shortest=4):
    words = (text or "").encode().split()
    n = len(words)
    lcp = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            if i != j and words[i] == words[j]:
                lcp[i][j] = lcp[i + 1][j + 1] + 1
    best = [max(lcp[i][:n], default=0) for i in range(n)]
    covered = {k for i in range(n) if best[i] >= shortest for k in range(i, i + best[i])}
    thrice = {k for i in range(n) if best[i] >= 3 for k in range(i, i + 3)}
    return n, len(covered), max(best, default=0), len(thrice)


def test_suffix_measures_equal_brute_force():
    texts = noise(2, 150, ["a ", "b ", "c ", "ab ", "\n"]) + ["", "x", "x x x x x x"]
    got = repetition_measures(texts, RepetitionRules())
    for i, text in enumerate(texts):
        n, covered, longest, thrice = plain_measures(text)
        assert got["n_words"][i] == n
        assert got["longest_repeat"][i] == longest
        assert round(got["covered_fraction"][i] * max(n, 1)) == covered
        assert got["n_repeat_words"][i] == thrice


def test_verdicts_on_messages(bodies):
    plain = " ".join(f"word{i}" for i in range(80))
    again = "\n".join(["the very same line of six"] * 20)
    rows = {r["rowid"]: r for r in
            repetition_verdicts(bodies(*ODD, plain, again, "a#b|\n \na#b|")).collect()}
    assert rows[7]["kept"] and not rows[7]["base_failed"]
    assert not rows[8]["kept"] and rows[8]["base_failed"]
    assert rows[8]["n_dup_lines"] == 19
    assert (rows[9]["n_symbols"], rows[9]["n_dup_lines"], rows[9]["word_chars"]) == (4, 1, 8)
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert repetition_verdicts(bodies().limit(0)).count() == 0
