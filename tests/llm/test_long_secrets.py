"""Secrets of any length are found and masked whole."""

import random
import string

from sievemark.llm import secret_scan

SIGNS = string.ascii_letters + string.digits


def signs(n, seed, alphabet=SIGNS):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def key(kind, body):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"


LINES = "\n".join(signs(64, i) for i in range(25)) + "\nabc12="
CASES = {
    "long_mixed": ("mixed", "aB3" + signs(600, 1)),
    "late_digit": ("mixed", signs(45, 2, string.ascii_letters) + "7" + signs(20, 3)),
    "very_long_mixed": ("mixed", "aB3" + signs(200_000, 4)),
    "long_payload": ("vendor_token", f"eyJ{signs(20, 5)}.{signs(2_403, 6)}.{signs(40, 7)}"),
    "long_signature": ("vendor_token", f"eyJ{signs(2_100, 8)}.{signs(30, 9)}.{signs(700, 10)}"),
    "long_ghp": ("vendor_token", "ghp_" + signs(300, 11)),
    "long_slack": ("vendor_token", "xoxb-" + signs(300, 12)),
    "long_sk": ("vendor_token", "sk-" + signs(300, 13)),
    "rsa": ("private_key", key("RSA ", LINES)),
    "headers": ("private_key", key("", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + LINES)),
    "long_name": ("private_key", key("A KEY WITH A NAME OF MORE THAN THIRTY TWO SIGNS ", LINES)),
    "holds_hex": ("private_key", key("EC ", "0123456789abcdef0123\n" + LINES)),
    "hyphens": ("private_key", key("", "-\n" * 50_000)),
}


def test_long_secrets_are_found_whole_and_masked(spark):
    rows = [(i, f"see {secret} there", f"s{i}") for i, (_, secret) in enumerate(CASES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["added"]} for r in secret_scan.find_secrets(docs).collect()}
    lost = [name for i, (name, (kind, secret)) in enumerate(CASES.items()) if (kind, 4, 4 + len(secret)) not in found[i]]
    assert not lost
    assert {r["text"] for r in secret_scan.mask_secrets(docs).collect()} == {"see [SECRET] there"}


def test_a_cut_off_key_does_not_reach_over_the_next_one(spark):
    cut, whole = "-----BEGIN RSA PRIVATE KEY-----", key("EC ", "ab")
    docs = spark.createDataFrame([(1, f"{cut} plain words {whole} -----BEGIN PRIVATE KEY----- no end", "s")], "doc_id long, text string, source string")
    spans = [(s["start"], s["end"]) for s in secret_scan.find_secrets(docs).first()["added"]]
    at = len(cut) + 13
    assert spans[:2] == [(0, len(cut)), (at, at + len(whole))] and len(spans) == 3


def test_runs_of_one_kind_of_sign_are_no_secrets(spark):
    docs = spark.createDataFrame([(1, f"{'a' * 40} {'A1' * 700} {'-' * 600} {'x9' * 300}", "s")], "doc_id long, text string, source string")
    assert not secret_scan.find_secrets(docs).first()["added"]
