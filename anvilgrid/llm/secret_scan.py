"""Secret scan with a random forest for false-positive removal, in DataFrame functions only.

Candidates are the tokens of at least LEAST characters with a digit or a known prefix, and what a cue with = or : assigns,
whatever its length and characters: up to a blank, a quote or an angle bracket, without punctuation at its end unless in
quotes; a key that an = joins to its value belongs to the token. A forest judges each by its length, the transitions of
its characters, how much of it a dictionary covers, its path and its neighbouring words. It is trained on the driver
from labelled findings (made by rule from a seed, FINDINGS of them), whose features the same column expressions compute,
and compiled to column expressions: texts never leave the JVM.

The pieces of a text between candidates and the candidates are exploded side by side; only their lengths and the nearest
words are dealt to number them, never the texts.

Defined cases: null or empty texts have no candidates; tokens of any length are one candidate; rows that repeat a row have
findings of their own; a null path counts as empty.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anvilgrid.llm.common import documents

LEAST, CONTEXT = 16, 64
#: A run of token characters with a digit; it begins where no token character is before.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
PREFIX = "(?:AKIA|ASIA|(?:ghp|gho|xox[bp]|sk|pk)[_-])"
CUE_WORDS = "(?i:pass|pwd|token|secret|api|key|auth|cred|bearer|login)"
#: A key with its sign, as it stands before a value (Java: bounded, to look behind).
ASSIGNED = CUE_WORDS + "[A-Za-z0-9_-]{0,24}[\"']?[ \\t]{0,8}[=:]{1,2}>?[ \\t]{0,8}"
BARE = "[^\\s\"'`<>]*[^\\s\"'`<>.,;:)\\]}]"
JOINED = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]++=)[A-Za-z0-9+/_-]{0,40}?" + CUE_WORDS + "[A-Za-z0-9_-]{0,24}=" + BARE
#: The look at one character spares most places the longer ones.
VALUE = f"(?<=[=:> \\t\"'])(?=[^\\s\"'`<>=:])(?<=[=:]>?[ \\t]{{0,8}}[\"']?)(?:(?<={ASSIGNED}\")[^\\s\"]+(?=\")|(?<={ASSIGNED}')[^\\s']+(?=')|(?<={ASSIGNED}[\"']?){BARE})"
#: Candidates and shorter tokens with a digit; for Java alone, as Python looks behind by fixed widths only.
FOUND = f"{JOINED}|{VALUE}|(?<![A-Za-z0-9+/_=-]){PREFIX}[A-Za-z0-9+/_=-]*+|{TOKEN}"
FINDINGS, TREES, DEPTH, SEED, THRESHOLD = 1200, 15, 6, 11, 0.5
DICTIONARY = "password passwd token secret example sample version license release public private test data user name file path page value index item number title image video article content default config service server client public report order region customer mail home info date time year month week document chapter section table figure".split()
COMMON = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
CUES = "(?i)(pass|pwd|token|secret|api|key|auth|cred|bearer|login)"
NAMES = ["length", "digits", "uppers", "lowers", "symbols", "turns", "common", "dictionary", "distinct", "hexadecimal", "assigned", "cue_before", "cue_after", "cue_inside", "prefixed", "plain_path"]


def share(pattern: str) -> Column:
    return F.regexp_count("token", F.lit(pattern)) / F.length("token")


def features() -> list[Column]:
    """From token, before, after (neighbouring text) and path."""
    bit = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("double")
    value = F.regexp_replace("token", "^[A-Za-z_-]+=", "")
    covered = F.length("token") - F.length(F.regexp_replace(F.lower("token"), "(" + "|".join(sorted(set(DICTIONARY), key=len, reverse=True)) + ")", ""))
    return [
        F.length("token").cast("double").alias("length"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"), share("[^A-Za-z0-9]").alias("symbols"),
        share("(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])").alias("turns"),
        (F.regexp_count(F.lower("token"), F.lit("(?=" + "|".join(COMMON) + ")")) / F.length("token")).alias("common"),
        (covered / F.length("token")).alias("dictionary"),
        (F.size(F.array_distinct(F.split("token", ""))) / F.length("token")).alias("distinct"),
        bit(value, "^[0-9a-f]{16,}$").alias("hexadecimal"),
        bit(F.concat(F.col("before"), F.lit("|"), F.col("token")), "[=:]\\s*[\"']?\\|.|^.*=[^=]").alias("assigned"),
        bit(F.col("before"), CUES).alias("cue_before"), bit(F.col("after"), CUES).alias("cue_after"), bit(F.col("token"), CUES).alias("cue_inside"),
        bit(F.col("token"), "^(AKIA|ASIA)[A-Z2-7]{16}$|^(ghp|gho|xox[bp]|sk|pk)[_-]").alias("prefixed"),
        bit(F.col("path"), "(?i)(test|example|sample|mock|fixture|docs?/)").alias("plain_path"),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[dict]:
    """Findings labelled by the rule that made them: keys, tokens and passwords against what only looks like them."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, low, up, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(r.choice(COMMON) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(n):
        before, after, path = f"{word()} {word()} ", f" {word()} {word()}", r.choice(["src", "app/main", "lib/util", "docs/page", "test/data"]) + str(r.randint(0, 30))
        secret = r.random() < 0.5
        kind = r.randrange(7)
        joined, key = r.random() < 0.4, r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "auth", "login"])
        if secret:
            if kind == 0:
                token = "AKIA" + pick(up + "234567", 16)
            elif kind == 1:
                token, before = pick(hexa, r.choice([32, 40, 64])), before + r.choice(["token", "api_key", "secret", "key"]) + r.choice([' = "', "=", ": "])
            elif kind == 2:
                token = r.choice(["password=", "passwd=", "secret=", "token="]) + pick(hexa, r.randint(14, 24))
            elif kind == 3:
                token = r.choice(["ghp_", "sk_", "xoxb-"]) + pick(up + low + digits, 32)
            elif kind == 5:
                begin = r.choice(["", word(), pick(low, r.randint(3, 8)), pick(low + up, r.randint(2, 6))]) or pick(up, 1) + pick(low, r.randint(2, 6))
                token = begin + pick(digits, r.randint(1, 3)) + r.choice(["", pick(low + digits + "!@#.$%&", r.randint(1, 6))])
            elif kind == 6:
                token = pick(low, r.randint(12, 26)) if r.random() < 0.3 else "".join(r.choice(COMMON) for _ in range(r.randint(6, 13)))
            else:
                token, before = pick(up + low + digits + "+/", r.choice([32, 40])), before + r.choice(["auth: ", 'secret = "', "credentials "])
        elif kind == 0:
            token = pick(digits, r.randint(16, 19))
        elif kind == 1:
            token = "-".join([word() for _ in range(r.randint(2, 5))] + [pick(digits, r.randint(1, 4))])
        elif kind == 2:
            token = f"{r.choice(DICTIONARY)}_{r.choice(DICTIONARY)}_{pick(digits, r.randint(1, 8))}"
        elif kind == 3:
            token = "/".join([word() for _ in range(r.randint(2, 6))] + [str(r.randint(1, 2030))])
        elif kind == 5:
            key = r.choice([key, key, "author", "keyword", "key", "passage"])
            token = r.choice([word(), word().capitalize(), r.choice(DICTIONARY), f"{r.choice(DICTIONARY)}_{r.choice(DICTIONARY)}", r.choice(["true", "false", "none", "null", "required", "string", "str"]), pick(digits, r.randint(1, 5)), f"v{r.choice(digits)}"])
            joined = joined and not token.isdigit()
        elif kind == 6:
            token = r.choice(["sk-", "pk-", "sk_", "pk_"]) + "-".join(word() for _ in range(r.randint(3, 6)))
            token += "" if len(token) >= LEAST else "-" + "".join(r.choice(COMMON) for _ in range(LEAST))
        else:
            token = word() + word() + word() + word() + pick(digits, r.randint(1, 2)) + word()
        if kind == 5 or kind == 6 and secret:  # behind a cue, whatever the length
            token, before = (f"{key}={token}", before) if joined else (token, before + key + r.choice([": ", ":", " = ", ' = "', '="']))
        elif not secret and kind != 6:  # the scanner finds these by a digit and their length alone
            token += "" if len(token) >= LEAST else pick(digits, LEAST - len(token))
        out.append({"token": token, "before": before[-CONTEXT:], "after": after[:CONTEXT], "path": path, "label": int(secret)})
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a share of secrets, or (feature, limit, tree up to it, tree above it); splits by Gini impurity."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0) or len(y) < 8:
        return round(p, 6)
    best = (p * (1 - p) * len(y) - 1e-9, None, None)
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n, left = cut + 1, c[cut]
        m, right = len(y) - n, c[-1] - left
        loss = left * (n - left) / n + right * (m - right) / m
        i = int(loss.argmin())
        if loss[i] < best[0]:
            best = (float(loss[i]), int(f), round(float((v[cut[i]] + v[cut[i] + 1]) / 2), 6))
    if best[1] is None:
        return round(p, 6)
    low = x[:, best[1]] <= best[2]
    if low.all() or not low.any():
        return round(p, 6)
    return (best[1], best[2], grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def train_forest(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> list:
    """Trees grown on bootstrap samples of the labelled findings."""
    schema = "array<struct<token:string,before:string,after:string,path:string,label:int>>"
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(labelled_findings(n, seed))), schema)).alias("f")).select("f.*")
    rows = made.select(*features(), "label").collect()
    x, y = np.array([[r[c] for c in NAMES] for r in rows], float), np.array([r["label"] for r in rows], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(TREES):
        own = rng.integers(0, len(y), len(y))
        out.append(grow(x[own], y[own], rng, DEPTH))
    return out


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, limit, low, high = tree
    return F.when(F.col(NAMES[feature]) <= limit, tree_column(low)).otherwise(tree_column(high))


def forest_score(trees: list) -> Column:
    total = tree_column(trees[0])
    for t in trees[1:]:
        total = total + tree_column(t)
    return F.round(total / len(trees), 6)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, finding (from 0 in each row), start (code points), token, before, after."""
    where = F.coalesce(docs[path].cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), where.alias("path"), docs["text"].alias("text")).where(F.col("text").rlike(f"[0-9=:]|{PREFIX}"))
    cut = rows.select("doc_id", "path", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(f"({FOUND})"), 1).alias("tokens"), F.split("text", FOUND, -1).alias("pieces"))
    each = cut.select("doc_id", "path", "row", F.posexplode(F.arrays_zip("tokens", F.slice("pieces", 1, F.size("tokens")).alias("befores"), F.slice("pieces", F.lit(2), F.size("tokens")).alias("afters"))).alias("finding", "f"))
    named = each.select(
        "doc_id", "path", "row", "finding", F.col("f.tokens").alias("token"), (F.length("f.befores") + F.length("f.tokens")).cast("long").alias("size"),
        F.right("f.befores", F.lit(CONTEXT)).alias("before"), F.left("f.afters", F.lit(CONTEXT)).alias("after"),
    )
    order = Window.partitionBy("row").orderBy("finding")
    placed = named.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("token"))
    # a key with a digit is itself a token, so it may lie before the piece
    key = F.right(F.concat(F.coalesce(F.right(F.lag("token").over(order), F.lit(CONTEXT)), F.lit("")), F.col("before")), F.lit(CONTEXT))
    ends, sign = f"{ASSIGNED}[\"']?$", "[=:]"
    seen = placed.withColumn("key", key).withColumn("before", F.when(~F.col("before").rlike(ends) & F.col("before").rlike(sign) & F.col("key").rlike(ends), F.col("key")).otherwise(F.col("before")))
    return seen.where((F.length("token") >= LEAST) | F.col("before").rlike(ends) | F.col("token").rlike(f"^{JOINED}")).drop("size", "row", "key")


def scan_secrets(docs: DataFrame, trees: list, path: str = "source") -> DataFrame:
    """Every candidate of every row with its score and verdict."""
    found = candidates(docs, path)
    return found.select("*", *features()).withColumn("score", forest_score(trees)).withColumn("is_secret", F.col("score") >= THRESHOLD).drop(*NAMES)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir), train_forest(spark))
    return found.select("doc_id", "start", F.length("token").cast("long").alias("length"), F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), "score", "is_secret")
