import hashlib
import re

from conftest_llm import documents, prose
from tidewire.llm import secrets


def digest(text, n):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


KEY = "Zx9Qp" + digest("k", 10).upper() + "kLmW7vB2"
PLANTED = {  # the text, and the secrets in it
    f'word token = "{digest("a", 40)}" word': [digest("a", 40)],
    f'{{"user":"ann","api_key":"{KEY}","client_secret":"{digest("b", 32)}","port":8080}}': [KEY, digest("b", 32)],
    "curl https://x.example/a?user=bob&access_token=" + KEY + "&page=2": [KEY],
    "password: hunter2longpw9": ["hunter2longpw9"],
    "db_password = Tr0ub4dor": ["Tr0ub4dor"],
    "auth_token=QwzJkvXhYpLmNbVc;": ["QwzJkvXhYpLmNbVc"],
    "passwd='p@ssW0rd!77'": ["p@ssW0rd!77"],
    "postgres://app:" + digest("c", 14) + "@db.internal/main": [digest("c", 14)],
    "Authorization: Bearer " + KEY: [KEY],
}
HARMLESS = [f"see commit {digest('d', 40)} for", "docs/reference/create_account/page_2024.html here", "token = your_token_here_xxxxxxxxxxxx1", "password: required", f"sha256: {digest('e', 64)}", "nothing here"]


def by_hand(text):
    """(piece number, value) of the candidates of a text."""
    pieces = re.split(secrets.CUTS, text)
    out = []
    for i, w in enumerate(pieces):
        told = " ".join(pieces[j][-secrets.NEIGHBOUR :] if j >= 0 else "" for j in (i - 2, i - 1))
        last = pieces[i - 1] if i else ""
        long_one = len(w) >= secrets.SHORTEST and re.search(secrets.LONG, w) and (re.search("[0-9]", w) and re.search("[A-Za-z]", w) or re.search("[a-z][A-Z]", w))
        named = re.search("[=:]$|(?i:^(?:is|bearer)$)", last) and len(w) >= secrets.SHORTEST_NAMED and re.search(secrets.NAMED, told)
        if long_one or named:
            out.append((i, w.rpartition("@")[0] if re.search("://[^/ ]*:$", told) and "@" in w else w))
    return out


def test_candidates_as_by_hand(spark, rng):
    texts = [*PLANTED, *HARMLESS, " ".join(PLANTED), "", *(prose(rng, 40) + " " + rng.choice([*PLANTED, *HARMLESS]) + "\n" + prose(rng, 9) for _ in range(40))]
    got = sorted((r.doc_id, r.at, r.value) for r in secrets.candidates(documents(spark, texts)).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in by_hand(t))


def test_planted(spark):
    texts = [None, "", *PLANTED, *HARMLESS, "x" * 200_000 + f' password = "{KEY}"', f"one = {KEY}", f"one = {KEY}"]
    docs = documents(spark, texts, ids=[*range(len(texts) - 1), len(texts) - 2], sources=["src", None] * (len(texts) // 2) + ["app"] * (len(texts) % 2))
    rows = secrets.secret_report(docs).collect()
    told = {(r.doc_id, r.value_sha256) for r in rows if r.is_secret}
    want = {(i + 2, hashlib.sha256(v.encode()).hexdigest()) for i, values in enumerate(PLANTED.values()) for v in values}
    assert want <= told
    harmless = range(2 + len(PLANTED), 2 + len(PLANTED) + len(HARMLESS))
    assert not [r for r in rows if r.is_secret and r.doc_id in harmless]
    assert any(i == harmless.stop for i, _ in told)
    assert len([r for r in rows if r.doc_id == len(texts) - 2]) == 2  # a repeated row
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_own_findings(spark):
    odd = spark.createDataFrame([("A" * 9 + f"{i:09d}z", "word", "word", "src", float(i % 2)) for i in range(40)], "value string, before string, after string, path string, label double")
    (row,) = secrets.secret_report(documents(spark, ["password: hunter2longpw9"]), odd).collect()
    assert 0 < row.score < 1


def test_forest_removes_false_positives(spark):
    rows = secrets.labelled_findings(spark).persist()
    train, held = rows.where("abs(xxhash64(value)) % 4 > 0"), rows.where("abs(xxhash64(value)) % 4 = 0")
    told = secrets.fitted(train).transform(secrets.described(held))
    assert told.where("prediction = label").count() / held.count() > 0.97
