"""How many planted random tokens the battery finds, of kinds that no base pattern covers, and what else it reports."""

import random
import string

from marlstone.llm import secrets

KINDS = {
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
    "base32": string.ascii_uppercase + "234567",
    "HEX": "0123456789ABCDEF",
}


def planted(seed, documents=600):
    """(rows, secret spans by document, ordinary spans by document): prose with random tokens, and with long tokens that aren't random."""
    r = random.Random(seed)
    parts = ["th", "er", "ing", "on", "an", "re", "tion", "es", "in", "st", "at", "en"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    rows, found, plain = [], {}, {}
    for k in range(documents):
        out = [word() for _ in range(r.randint(60, 200))]
        if k % 3 == 0:
            n = r.choice([24, 32, 40, 64])
            token = "".join(r.choice(KINDS[r.choice(list(KINDS))]) for _ in range(n))
            out.insert(r.randrange(len(out)), token)
        if k % 3 == 1:
            token = r.choice([lambda: "/".join(word() for _ in range(9)), lambda: "".join(word().capitalize() for _ in range(8)), lambda: "_".join(word() for _ in range(8)), lambda: "-" * 40, lambda: "0123456789" * 3, lambda: "a1" * 16])()
            out.insert(r.randrange(len(out)), token)
        text = " ".join(out)
        if k % 3 < 2:
            at = text.index(token)
            (found if k % 3 == 0 else plain)[k] = (at, at + len(token))
        rows.append((k, text))
    return rows, found, plain


def measured(rows, found):
    def outcome(out):
        hit = sum(any(s.kind == "random" and s.start <= found[x.doc_id][0] and s.end >= found[x.doc_id][1] - 1 for s in x.secrets) for x in out if x.doc_id in found)
        reported = [(x.doc_id, s.start, s.end) for x in out for s in x.secrets if s.kind == "random"]
        wrong = sum(d not in found or e <= found[d][0] or s >= found[d][1] for d, s, e in reported)
        return hit / len(found), wrong / max(1, len(reported))

    return outcome


def test_planted_tokens_are_found_and_ordinary_ones_are_not(spark):
    for seed in (41, 42):
        rows, found, _ = planted(seed)
        out = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        recall, wrong = measured(rows, found)(out)
        print(f"seed {seed}: recall {recall:.3f}, share of wrong reports {wrong:.3f}")
        assert recall >= 0.9 and wrong <= 0.05
