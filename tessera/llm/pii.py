"""Personal data and secrets in text: base patterns, and further spans by weak supervision. DataFrame functions only.

Each kind's pattern finds its matches (leftmost, not overlapping); the pieces between matches give their
places in code points in one pass. A match of a base kind that passes its kind's check is a base span and always stays.
Matches that fail their check, and all matches of the kind secret (keys, tokens, passwords: long runs of letters and digits), are
candidates: labelers vote on them by form (regex), by lists of issuers, calling codes and key prefixes
(gazetteer) and by what stands around them (context). Expectation-maximisation over the counts of vote patterns
of the whole corpus, which are few whatever its size, estimates how reliable each labeler is for each kind; base spans take
part as known cases. A logistic regression trained on the posteriors decides alone which candidates become spans too.

The patterns are the contract's, written so that no text makes them slow or deep: what can't match from a
run's start can't match from inside it, so runs are entered only at their start or where a match ended, and
repetitions that nothing can make shorter are possessive.

Defined results: a null text is empty; rows without spans have counts of zero, the SHA-256 of the empty
string and an empty span list; repeated rows and rows with a null id are treated alike; very long texts are read whole; an empty table gives
no rows; other columns are ignored (redact keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare, stored, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
#: What a text must hold for a kind's pattern to be tried; a card or candidate has 13 digits at least.
PRESENT = {"email": "contains({t}, '@')", "ip": r"{t} rlike r'[0-9]\.[0-9]'", "card": r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){{12}}'", "phone": "contains({t}, '+')", "secret": "{t} rlike '[0-9]' and {t} rlike '[A-Za-z0-9_+/-]{{16}}'"}
DIGITS = "regexp_replace(@s, '[^0-9]', '')"
LUHN = f"aggregate(transform(split(reverse({DIGITS}), ''), (c, i) -> cast(if(i % 2 = 1, translate(c, '0123456789', '0246813579'), c) as int)), 0, (a, c) -> a + coalesce(c, 0)) % 10 = 0"
#: The contract's checks of a match; nothing makes a secret certain.
CHECK = {
    "email": "true",
    "ip": r"forall(split(@s, r'\.'), p -> cast(p as double) <= 255)",
    "card": f"length({DIGITS}) between 16 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 8 and 15",
    "secret": "false",
}
#: Matches that are worth a vote, if they aren't base spans.
CANDIDATE = {"email": "true", "ip": "true", "card": f"length({DIGITS}) between 13 and 19", "phone": f"length({DIGITS}) between 7 and 18", "secret": "@s rlike '[0-9]' and @s rlike '[A-Za-z]'"}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|courriel|correo|schreib)",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse)",
    "card": r"(?i)(?:card|visa|master|credit|cc|karte|carte|tarjeta)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|ruf|appel|llam|whatsapp)",
    "secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|credential|auth)[^\p{L}0-9]{0,8}$",
}
#: Words before runs that are public by nature: digests, versions of files, identifiers.
PUBLIC = r"(?i)(?:sha-?[0-9]*|md5|commit|digest|checksum|hash|uuid|etag|integrity|revision|\bid)[^\p{L}0-9]{0,8}$"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza|glpat-)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|36|38|30[0-5])"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
TOPS = r"\.(?:com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us|in)$"
#: One character a labeler: 1 yes, 0 no, - nothing. @s: the match, @b: text before it, @a: after it.
LABELERS = {
    "check": "case @kind when 'secret' then if(length(@s) >= 20 and length({digits}) >= 4, '1', '0') else if({check}, '1', '0') end",
    "form": r"""case @kind when 'card' then if(@s rlike '^[0-9]{{4}}([ -]?)[0-9]{{4}}([ -]?)[0-9]{{4}}([ -]?)[0-9]{{1,7}}$', '1', '0')
        when 'phone' then if(@s rlike r'^\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?([ .-]?[0-9]{{2,4}}){{2,4}}$', '1', '0')
        when 'secret' then if(@s rlike '^(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})$' or (@s rlike '[a-z]' and @s rlike '[A-Z]' and not @s rlike '[/-]'), '1', '0') else '-' end""",
    "gazetteer": f"case @kind when 'email' then if(@s rlike r'{TOPS}', '1', '-') when 'card' then if({DIGITS} rlike '{ISSUERS}', '1', '0') when 'phone' then if(@s rlike r'{CALLING}', '1', '0') when 'secret' then if(@s rlike r'{PREFIXES}', '1', '-') else '-' end",
    "cue": "if(@b rlike {cue}, '1', '-')",
    "counting": r"if(@b rlike r'(?i)(?:[$€£#]|\b(?:no|nr|version|v)\.?)\s*$' or @b rlike r'{public}', '0', '-')",
    "uniform": f"if(length(regexp_replace({DIGITS}, substr({DIGITS}, 1, 1), '')) = 0 and @kind <> 'email', '0', '-')",
    "embedded": r"if(@b rlike r'[\p{{L}}0-9_]$' or @a rlike r'^[\p{{L}}0-9_@]' or (@kind = 'secret' and @b rlike r'[.:]/{{0,2}}$'), '0', '-')",
    "quoted": r"""if(@b rlike r'[=:]\s*[\x22\x27]$' or @b rlike r'[=:]\s*$', '1', '-')""",
}
SPAN = "struct<kind:string,start:int,stop:int,base:boolean,votes:string>"


def rules(kind: str) -> tuple[str, str, str]:
    """SQL over a match x (s, b before, a after): the check, what is kept, and the votes."""
    fill = {"check": CHECK[kind], "cue": "r'" + CUES[kind] + "'", "digits": DIGITS, "public": PUBLIC}
    votes = "concat(" + ", ".join(v.format(**fill) for v in LABELERS.values()) + ")"
    return tuple(q.replace("@kind", f"'{kind}'").replace("@s", "x.s").replace("@b", "x.b").replace("@a", "x.a") for q in (CHECK[kind], f"({CHECK[kind]}) or ({CANDIDATE[kind]})", votes))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, found): the text and its base spans and candidates with their votes."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return with_spans(df).select("id", "t", "found")


def with_spans(df: DataFrame, prefix: str = "") -> DataFrame:
    """df, which has a column t, with the column found."""
    per_kind = []
    for kind in KINDS:
        pattern = "r'" + PATTERN[kind] + "'"
        check, wanted, votes = rules(kind)
        # places: lengths of the pieces between matches and of the matches so far
        placed = f"""aggregate(
            zip_with(ms, slice(ps, 1, size(ms)), (m, p) -> named_struct('s', m, 'b', right(p, 32), 'gap', length(p))),
            named_struct('at', 0, 'out', cast(array() as array<struct<s:string,b:string,start:int>>)),
            (acc, x) -> named_struct('at', acc.at + x.gap + length(x.s), 'out', array_append(acc.out, named_struct('s', x.s, 'b', x.b, 'start', acc.at + x.gap))),
            acc -> transform(acc.out, (x, i) -> named_struct('s', x.s, 'b', x.b, 'start', x.start, 'a', left(get(ps, i + 1), 1))))"""
        kept = f"transform(filter({placed}, x -> {wanted}), x -> named_struct('kind', '{kind}', 'start', x.start, 'stop', x.start + length(x.s), 'base', coalesce({check}, false), 'votes', {votes}))"
        one = kept.replace("ms", f"__m_{kind}").replace("ps,", f"__p_{kind},").replace("(ps", f"(__p_{kind}")
        per_kind.append((kind, pattern, one))
    for kind, pattern, _ in per_kind:
        present = PRESENT[kind].format(t="t")
        df = df.withColumn(f"__m_{kind}", F.expr(f"if({present}, regexp_extract_all(t, {pattern}, 0), cast(array() as array<string>))"))
    for kind, pattern, _ in per_kind:
        df = df.withColumn(f"__p_{kind}", F.expr(f"if(size(__m_{kind}) > 0, split(t, {pattern}, -1), cast(array() as array<string>))"))
    found = "concat(" + ", ".join(f"if(size(__m_{k}) > 0, {one}, cast(array() as array<{SPAN}>))" for k, _, one in per_kind) + ")"
    return df.withColumn("found", F.expr(found)).drop(*[f"__{x}_{k}" for x in "mp" for k in KINDS])


Counts = dict[tuple[str, str, bool], int]


def em(counts: Counts, rounds: int = 60) -> dict[tuple[str, str, bool], float]:
    """The probability of being personal data of each (kind, votes, base), by the reliabilities of each kind's labelers."""
    post = {k: 1.0 if k[2] else 0.3 if "0" in k[1] else 0.9 for k in counts}  # what a labeler speaks against starts as doubtful
    for _ in range(rounds):
        new = {}
        for kind in {k[0] for k in counts}:
            own = [k for k in counts if k[0] == kind]
            total = [sum((post[k] if y else 1 - post[k]) * counts[k] for k in own) + 1 for y in (0, 1)]
            open_cases = [k for k in own if not k[2]]  # the prior is theirs; base spans only tell how labelers vote
            prior = (sum(post[k] * counts[k] for k in open_cases) + 1) / (sum(counts[k] for k in open_cases) + 2)
            rate = {}
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    for v in "01-":
                        start = 3.0 if (v == "1") == bool(y) and v != "-" else 1.0
                        rate[j, y, v] = (sum((post[k] if y else 1 - post[k]) * counts[k] for k in own if k[1][j] == v) + start) / (total[y] + 5)
            for k in own:
                z = math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(k[1]))
                new[k] = 1.0 if k[2] else 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        if max((abs(new[k] - post[k]) for k in counts), default=0) < 1e-7:
            return new
        post = new
    return post


def classifier(counts: Counts, post: dict[tuple[str, str, bool], float], rounds: int = 600) -> dict[tuple[str, str, bool], float]:
    """A logistic regression on votes by kind, trained on the posteriors; its probability of each (kind, votes, base)."""
    feats = {k: [f"kind={k[0]}", *(f"{k[0]}:{j}={v}" for j, v in enumerate(k[1])), "bias"] for k in counts}
    w = dict.fromkeys((f for fs in feats.values() for f in fs), 0.0)
    total = sum(counts.values()) or 1
    share = {f: sum(n for k, n in counts.items() if f in feats[k]) / total for f in w}
    p = {}
    for _ in range(rounds):
        p = {k: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in fs))))) for k, fs in feats.items()}
        grad = dict.fromkeys(w, 0.0)
        for k, fs in feats.items():
            for f in fs:
                grad[f] += (p[k] - post[k]) * counts[k] / total
        for f in w:
            w[f] -= max(-1.0, min(1.0, 0.5 * grad[f] / (share[f] + 1e-3))) + 1e-4 * w[f]
    return p


def accepted(found: DataFrame, threshold: float = 0.9) -> list[str]:
    """Kinds with votes ("kind:votes") whose candidates become spans; learned from all of found."""
    seen = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.base").agg(F.count("*").alias("n"))
    counts = {(r.kind, r.votes, r.base): r.n for r in seen.collect()}  # at most 2 x kinds x 3^labelers rows
    p = classifier(counts, em(counts)) if counts else {}
    return sorted(f"{k}:{v}" for (k, v, base), x in p.items() if x >= threshold and not base)


def chosen(accept: list[str]) -> Column:
    """found without the candidates that weren't accepted."""
    ok = F.array(*[F.lit(a) for a in accept]) if accept else F.array().cast("array<string>")
    return F.filter("found", lambda x: x.base | F.array_contains(ok, F.concat(x.kind, F.lit(":"), x.votes)))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas; found lists kinds in order and spans in order of place."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts by kind, base_sha256, spans); see the module's docstring."""
    found = stored(find(docs, id_col, text_col).select("id", "found"), "pii-found")
    base = F.filter("found", lambda x: x.base)
    counts = [F.expr(f"cast(size(filter(found, x -> x.base and x.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(chosen(accepted(found))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    columns = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(columns)}  # other columns may have any name
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    text = inner[text_col]
    found = stored(with_spans(df.withColumn("t", F.coalesce(text, F.lit("")))).drop("t"), "pii-text")
    spans = F.sort_array(F.transform(chosen(accepted(found)), lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop"), x.kind.alias("kind"))))
    df = found.withColumn("spans", spans)
    replaced = f"""aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, x) -> if(x.start >= acc.at,
            named_struct('at', x.stop, 'out', concat(acc.out, substr({text}, acc.at + 1, x.start - acc.at), '[', upper(x.kind), ']')),
            named_struct('at', greatest(acc.at, x.stop), 'out', acc.out)),
        acc -> concat(acc.out, substr({text}, acc.at + 1)))"""
    df = df.withColumn(text, F.expr(f"if({text} is null or size(spans) = 0, {text}, {replaced})"))
    return df.select(*[F.col(n).alias(c) for c, n in inner.items()])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return detect(table(spark, sf_dir, "documents"))
