"""Queries of the text functions over whole documents and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.dims import ANCHOR_ALIASES, BAD_ENDINGS, BAD_OPENINGS, CRITERIA, DEFAULT_EVIDENCE, ORIGIN_ALIASES, PREDICTION_ALIASES, lookup
from tesselade.functions import text as X
from tesselade.session import table

B = r"[\t-\r\x1c-\x20\x{85}\pZ]"  # blanks, for RE2


def sql_clean(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{B}+', ' ', 'g'))"


def sql_let(name, value, body):
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sql_words(x):
    return f"list_filter(string_split({sql_clean(x)}, ' '), lambda w: w <> '')"


def sql_sentences(x):
    return f"list_filter(string_split(regexp_replace({sql_clean(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def sql_strip(x):
    bare = f"regexp_replace({sql_clean(x)}, '^\\*\\*(.*?)\\*\\*: *', '')"
    return sql_clean(f"replace(regexp_replace({bare}, '^[A-Z][A-Za-z& /\\-]+: *', ''), '**', '')")


def sql_clip(x, n):
    return f"regexp_replace(array_to_string(({sql_words(x)})[1:{n}], ' '), '[ ,;:.]+$', '')"


def sql_viable(x):
    endings = ", ".join(f"'{w}'" for w in BAD_ENDINGS)
    return sql_let("vt", sql_clean(x), f"(len({sql_words('vt')}) >= 6 and not regexp_matches(lower(vt), '^({'|'.join(BAD_OPENINGS)})') and lower(regexp_replace(string_split(vt, ' ')[-1], '[.,;:!?]+$', '')) not in ({endings}))")


def sql_fitting(x, separators, n):
    parts = f"list_transform(regexp_split_to_array({x}, '{separators}'), lambda cp: {sql_clean('cp')})"
    return f"coalesce(list_filter({parts}, lambda fp: fp <> '' and len({sql_words('fp')}) <= {n} and {sql_viable('fp')})[1], {x})"


def sql_ended(x):
    bare = f"regexp_replace(regexp_replace({x}, '^[ \"'']+|[ \"'']+$', '', 'g'), '\\.\\.+', '.', 'g')"
    return sql_let("et", bare, "case when et <> '' and not regexp_matches(et, '[.!?]$') then et || '.' else et end")


def sql_compact(x, n, default):
    long = lambda t: f"len({sql_words(t)}) > {n}"
    steps = sql_let("c1", "c0", f"case when {long('c1')} then {sql_fitting('c1', '[;:]', n)} else c1 end")
    steps = sql_let("c2", steps, f"case when {long('c2')} then {sql_fitting('c2', ',', n)} else c2 end")
    steps = sql_let("c3", steps, f"case when {long('c3')} then {sql_clip('c3', n)} else c3 end")
    steps = sql_let("c4", sql_ended(steps), f"case when c4 <> '' then c4 else {default} end")
    body = sql_let("c0", f"coalesce(({sql_sentences('st')})[1], st)", steps)
    return sql_let("st", sql_strip(x), f"case when st = '' then {default} else {body} end")


def sql_evidence(x, n=28):
    d = f"'{DEFAULT_EVIDENCE}'"
    compact = sql_compact("replace(es, '...', '.')", n, d)
    return sql_let("es", sql_strip(x), f"case when es = '' or lower(es) = lower({d}) then {d} else {compact} end")


def sql_segment(x):
    return sql_let("gs", f"replace({sql_strip(x)}, '...', '.')", f"regexp_replace(coalesce(({sql_sentences('gs')})[1], gs), '\\.+$', '')")


def sql_key(x):
    return f"trim(regexp_replace(lower({sql_clean(x)}), '[^a-z0-9]+', ' ', 'g'))"


def sql_canonical(x, names, key, otherwise="null"):
    exact = ", ".join(f"'{c}'" for c in CRITERIA)
    cases = " ".join(f"when '{a}' then '{c}'" for a, c in names.items())
    return f"case when {sql_clean(x)} in ({exact}) then {sql_clean(x)} else coalesce(case {key(x)} {cases} end, {otherwise}) end"


def sql_member(x):
    ends = f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"
    return f"regexp_replace(regexp_replace(replace({ends}, '\\', '/'), '^\\./', ''), '^dataset/', '')"


def sql_label(x):
    return f"case when list_contains(string_split({x}, '/'), '0_real') then 'Real' when list_contains(string_split({x}, '/'), '1_fake') then 'AI-Generated' end"


SQL_TOKENS = f"regexp_extract_all(lower({sql_clean('text')}), '[\\pL\\pN_]+|[^\\pL\\pN_ ]')"


def _docs(**columns):
    """Columns of the text, built when the query is: that needs a session."""
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", *[c(F.col("text")).alias(n) for n, c in columns.items()])


ANCHORS, PREDICTED, ORIGIN = lookup(ANCHOR_ALIASES), lookup(PREDICTION_ALIASES), lookup(ORIGIN_ALIASES)
ANCHOR_KEYS = {c.lower(): c for c in CRITERIA} | ANCHORS


def _criteria(spark, sf_dir):
    names = [F.col(f"{t}.per_criterion").getField("criterion") for t in ("final_json_target", "evidence_trace_target", "consistency_target")]
    return table(spark, sf_dir, "derived").select(F.explode(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def canonicalize_alias(spark, sf_dir):
    lower = lambda c: F.lower(X.clean_text(c))
    name = F.col("name")
    return _criteria(spark, sf_dir).select(
        "name", "n", X.lookup_key(name).alias("lookup_key"), X.canonical(name, ANCHOR_KEYS, lower).alias("teacher"),
        X.canonical(name, PREDICTED, X.lookup_key, X.clean_text(name)).alias("prediction"), X.canonical(name, ORIGIN, X.lookup_key).alias("origin"),
    )


def token_topk(spark, sf_dir):
    """The fifty most frequent tokens: a top-k report."""
    found = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


def image_member_normalize(spark, sf_dir):
    member = X.image_member(F.try_element_at("images", F.lit(1)))
    rows = table(spark, sf_dir, "source_records").select("line_no", member.alias("member"))
    return rows.select("line_no", "member", F.concat(F.lit("images/"), "member").alias("output_path"), X.label_from_member(F.col("member")).alias("label"))


def resolve_paths(spark, sf_dir):
    return table(spark, sf_dir, "derived").select("row_id", X.resolve_path(F.col("image"), F.col("image_root"), "/data").alias("path"))


def step1_texts(spark, sf_dir):
    label = X.normal_label(F.col("final_json_target.overall_likelihood"))
    return table(spark, sf_dir, "derived").select("row_id", X.step1_text(F.col("step1_target"), label).alias("step1"), label.alias("label"))


QUERIES = {
    "clean_text_docs": _docs(cleaned=lambda t: X.clean_text(t)),
    "lookup_key_docs": _docs(lookup_key=lambda t: X.lookup_key(t)),
    "sentence_split_counts": _docs(n_sentences=lambda t: F.size(X.sentences(t))),
    "first_sentence": _docs(sentence=lambda t: X.first_sentence(t)),
    "token_counts": _docs(n_tokens=lambda t: F.size(X.tokens(t))),
    "token_topk": token_topk,
    "truncate_words_docs": _docs(short=lambda t: X.truncate_words(t, 14), whole=lambda t: X.truncate_words(t, 0)),
    "clip_words_plain": _docs(clipped=lambda t: X.clip_words_plain(t, 25)),
    "viable_fragments": _docs(viable=lambda t: X.is_viable_fragment(X.first_sentence(t))),
    "strip_leading_label": _docs(stripped=lambda t: X.strip_leading_label(t)),
    "compact_text": _docs(compact=lambda t: X.compact_text(t, 12), clipped=lambda t: X.clip_words(t, 8)),
    "evidence_sentence": _docs(evidence=lambda t: X.evidence_sentence(t)),
    "step1_segment": _docs(segment=lambda t: X.step1_segment(t)),
    "step1_texts": step1_texts,
    "canonicalize_alias": canonicalize_alias,
    "image_member_normalize": image_member_normalize,
    "resolve_paths": resolve_paths,
}


def _sql(**columns):
    return "select doc_id, " + ", ".join(f"{c} as {n}" for n, c in columns.items()) + " from documents"


_STEP1 = sql_let(
    "kt",
    sql_let(
        "k0",
        f"""case when {sql_clean('step1_target')} <> '' then {sql_clean('step1_target')} when {{label}} = 'AI-Generated' then 'Key points: Holmes explanation indicates localized artifacts that support an AI-generated label.'
 else 'Key points: Holmes explanation supports a Real label without clear AIGC artifacts.' end""",
        "case when lower(k0) like 'key points:%' then k0 else 'Key points: ' || k0 end",
    ),
    f"""trim(string_split(kt, ':')[1] || ': ' || array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(substr(kt, strpos(kt, ':') + 1), '[;\\n]+'),
 lambda kp: {sql_clean('kp')} <> ''), lambda ks: {sql_segment('ks')})[1:3], lambda kx: kx <> ''), '; '))""",
)
_LABEL = sql_let("lt", sql_clean("final_json_target.overall_likelihood"), "case when lt in ('Real', 'AI-Generated') then lt else 'Uncertain' end")

ORACLE = {
    "clean_text_docs": _sql(cleaned=sql_clean("text")),
    "lookup_key_docs": _sql(lookup_key=sql_key("text")),
    "sentence_split_counts": _sql(n_sentences=f"cast(len({sql_sentences('text')}) as integer)"),
    "first_sentence": _sql(sentence=f"coalesce(({sql_sentences('text')})[1], '')"),
    "token_counts": _sql(n_tokens=f"cast(len({SQL_TOKENS}) as integer)"),
    "token_topk": f"select token, count(*) as n from (select unnest({SQL_TOKENS}) as token from documents) group by 1 order by n desc, token limit 50",
    "truncate_words_docs": _sql(short=f"array_to_string(({sql_words('text')})[1:14], ' ')", whole=sql_clean("text")),
    "clip_words_plain": _sql(clipped=sql_clip("text", 25)),
    "viable_fragments": _sql(viable=sql_viable(f"coalesce(({sql_sentences('text')})[1], '')")),
    "strip_leading_label": _sql(stripped=sql_strip("text")),
    "compact_text": _sql(compact=sql_compact("text", 12, "''"), clipped=sql_compact("text", 8, sql_clean("text"))),
    "evidence_sentence": _sql(evidence=sql_evidence("text")),
    "step1_segment": _sql(segment=sql_segment("text")),
    "step1_texts": f"select row_id, {_STEP1.replace('{label}', 'label')} as step1, label from (select *, {_LABEL} as label from derived)",
    "canonicalize_alias": f"""with n as (select unnest(list_concat(list_concat(coalesce(list_transform(final_json_target.per_criterion, lambda e: e.criterion), []), coalesce(list_transform(evidence_trace_target.per_criterion, lambda e: e.criterion), [])),
 coalesce(list_transform(consistency_target.per_criterion, lambda e: e.criterion), []))) as name from derived)
select name, count(*) as n, {sql_key('name')} as lookup_key, {sql_canonical('name', ANCHOR_KEYS, lambda x: f"lower({sql_clean(x)})")} as teacher,
 {sql_canonical('name', PREDICTED, sql_key, sql_clean('name'))} as prediction, {sql_canonical('name', ORIGIN, sql_key)} as origin from n where name is not null group by name""",
    "image_member_normalize": f"select line_no, member, 'images/' || member as output_path, {sql_label('member')} as label from (select line_no, {sql_member('images[1]')} as member from source_records)",
    "resolve_paths": "select row_id, case when image like '/%' then image else concat_ws('/', coalesce(image_root, '/data'), image) end as path from derived",
}
