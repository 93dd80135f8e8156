"""The opN queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import chat, exact, fim, licenses, line_dedup, mixing, ngram_join, packing, quality, secrets, toxicity, warc, whitening
from wattline.llm.text import shared_dir, table

#: A conversation whose texts are made of control strings.
_EXTRA = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{_EXTRA}'), (-1L, 1L, 'assistant', '{_EXTRA}') as t(conv_id, turn, role, text)")
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.read_archives(spark, path, payloads=False)
    return back.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.ledger(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), size=3, threshold=(90, 100))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = line_dedup.dedup_lines(docs)
    return clean.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fim.fill_in_middle(docs, with_output=False)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_format, op2_license_scan, op3_warc, op4_quality_rules, op5_ngram_jaccard, op6_toxicity, op7_line_dedup,
        op8_exact_dedup, op9_source_mix, op10_pack, op11_secret_scan, op12_whitening, op13_fill_in_middle,
    )
    return {f.__name__: f for f in every}


def _op1_sql() -> str:
    escaped = "text"
    for first, rest in ((m[0], m[1:]) for m in chat.control_strings(chat.TEMPLATE)):
        esc = "".join("\\" + c if c in "[]/<>" and c in "[]" else c for c in rest)
        lead = "\\" + first if first == "[" else first
        escaped = f"regexp_replace({escaped}, '{lead}(\\\\*){esc}', '{first}\\\\\\1{rest}', 'g')"
    marks = " ".join(f"when '{r}' then {len(m['open']) + len(m['close'])}" for r, m in chat.TEMPLATE["turns"].items())
    other = sum(len(x) for x in chat.TEMPLATE["other"].values())
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_EXTRA}' union all select -1, 1, 'assistant', '{_EXTRA}'),
e as (select *, length({escaped}) + case role {marks} else {other} + length(role) end as n from c),
g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '') as learnt,
    sum(n) as formatted_chars,
    list(role order by turn nulls first, role, text) as roles
  from e group by conv_id),
v as (select *, list_transform(range(1, len(roles) + 1), lambda i: case
    when i = 1 then roles[1] in ('system', 'user')
    when roles[i - 1] in ('system', 'assistant') then roles[i] = 'user'
    when roles[i - 1] = 'user' then roles[i] = 'assistant' else false end) as ok from g)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learnt) as loss_chars,
  sha256(learnt) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars,
  coalesce(list_position(ok, false), 0) = 0 and roles[len(roles)] in ('user', 'assistant') as valid,
  cast(case when coalesce(list_position(ok, false), 0) > 0 then list_position(ok, false) - 1
    when roles[len(roles)] not in ('user', 'assistant') then len(roles) end as integer) as error_turn
from v
"""


_OP4_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 3)) as p, ws from w where len(ws) >= 5),
h as (select doc_id, p, array_to_string(ws[p:p+4], ' ') as k from g),
r as (select doc_id, k from h group by doc_id, k having count(*) > 1),
c as (select distinct doc_id, unnest([p, p+1, p+2, p+3, p+4]) as q from h join r using (doc_id, k)),
n as (select doc_id, count(*) as n_repeat_words from c group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w join l using (doc_id) left join n using (doc_id)),
b as (select *, cast(
    case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words then 4 else 0 end + case when word_chars < 2 * n_words then 8 else 0 end
    + case when word_chars > 20 * n_words then 16 else 0 end
    + case when n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines then 32 else 0 end as bigint) as fail_bits from m)
select *, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept from b
"""

_OP8_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def _op2_sql() -> str:
    low = f"translate(x, '{licenses.UPPER}', '{licenses.LOWER}')"
    norm = f"trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"
    known = " ".join(f"when '{k}' then '{v}'" for k, v in licenses.KNOWN.items())
    like = " ".join(f"when regexp_matches(x, '{p}') then '{n}'" for n, p in licenses.PATTERNS.items())
    ident = f"case x {known} else case {like} else '_' end end"
    mark = "regexp_replace({}, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g')"
    out = [f"with d as (select doc_id, regexp_replace(coalesce(text, ''), '(?m){licenses.COMMENT}', '', 'g') as t from documents)"]
    by_line = f"string_split(replace(replace({mark.format('t')}, chr(10), chr(1)), chr(13), chr(1)), chr(1))"
    para = "regexp_replace(t, '\\n[\\x20\\x09-\\x0D]*\\n', chr(2), 'g')"
    joined = f"string_split(replace({mark.format(f"regexp_replace({para}, '[\\n\\r]+', ' ', 'g')")}, chr(2), chr(1)), chr(1))"
    out.append(f"p as (select doc_id, 'l' as cut, {by_line} as s from d union all select doc_id, 'j', {joined} from d)")
    out.append(f"n as (select doc_id, cut, list_filter(list_transform(s, lambda x: {norm}), lambda x: x <> '' and not regexp_matches(x, '{licenses.ITEM}')) as s from p)")
    line, later = licenses.SPDX_LINE, "' or later', ' orlater'"
    parts = f"string_split_regex(replace(substr(x, {len(line) + 1}), {later}), '{licenses.SPDX_JOINTS}')"
    each = f"list_transform({parts}, lambda y: '{line}' || replace(y, ' orlater', ' or later'))"
    out.append(f"m as (select doc_id, cut, flatten(list_transform(s, lambda x: case when starts_with(x, '{line}') then {each} else [x] end)) as s from n)")
    ids = f"',' || array_to_string(list_transform(s, lambda x: {ident}), ',,') || ','"
    out.append(f"q0 as (select doc_id, cut, {ids} as i, [] :: varchar[] as f, len(list_filter(list_transform(s, lambda x: {ident}), lambda x: x <> '_')) as n from m)")
    out.append("r0 as (select doc_id, cut, regexp_replace(i, '(,_,)+', ',_,', 'g') as i, f, n from q0)")
    for k, (name, seq) in enumerate(licenses.RULES):
        pat = "," + ",,".join(seq) + ","
        out.append(f"r{k + 1} as (select doc_id, cut, replace(i, '{pat}', ',#,') as i, case when contains(i, '{pat}') then list_append(f, '{name}') else f end as f, n from r{k})")
    names = list(dict.fromkeys(n for n, _ in licenses.RULES))
    last = f"r{len(licenses.RULES)}"
    out.append(
        f"z as (select doc_id, list_filter({names}, lambda m: list_contains(flatten(list(f)), m)) as f, max(n) as n_known, "
        f"min(len(list_filter(string_split(i, ','), lambda x: x not in ('', '_', '#')))) as n_unclaimed from {last} group by doc_id)"
    )
    return ",\n".join(out) + (
        "\nselect doc_id, array_to_string(f, ',') as licenses, cast(n_known as bigint) as n_known, cast(n_unclaimed as bigint) as n_unclaimed, "
        "case when len(f) > 0 then 'licensed' when n_known > 0 then 'unclaimed' else 'none' end as status from z"
    )


_OP7_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents),
w as (select doc_id, line_no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
u as (
  select array_to_string(ws, ' ') as k, any_value(ws) as ws, min({'d': doc_id, 'l': line_no}) as first
  from w where len(ws) > 0 group by all),
x as (select k, ws, first, unnest(range(1, len(ws) + 1)) as p from u where len(ws) >= 10),
y as (select k, first, unnest(range(1, length(k) + 1)) as p from u where len(ws) < 10 and length(k) >= 10),
v as (select 'w' as kind, k, first, p, array_to_string(list_concat(ws[1:p-1], ws[p+1:len(ws)]), ' ') as r from x
  union all select 'c', k, first, p, k[1:p-1] || k[p+1:length(k)] from y),
z as (select 'w' as kind, k, first from u where len(ws) >= 9 union all select 'c', k, first from u where len(ws) < 10),
b as (select distinct a.k from v a join v b on a.kind = b.kind and a.r = b.r and a.p = b.p where b.first < a.first
  union select a.k from z a join v b on a.kind = b.kind and a.k = b.r where b.first < a.first
  union select a.k from v a join z b on a.kind = b.kind and a.r = b.k where b.first < a.first),
j as (
  select w.doc_id, w.line_no, w.line, len(w.ws) > 0 as has, {'d': w.doc_id, 'l': w.line_no} <> u.first as copy, b.k is not null as near
  from w left join u on u.k = array_to_string(w.ws, ' ') and len(w.ws) > 0 left join b on b.k = u.k)
select doc_id, count(*) filter (where has) as n_lines, count(*) filter (where has and copy) as n_copies,
  count(*) filter (where has and near and not copy) as n_near,
  sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (where not has or not (copy or near)), '')) as text_sha256
from j group by doc_id
"""

_OP3_SQL = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select *, sha1(t) as h, min(page_id) over (partition by t) as first from p),
b as (select *, list_transform(range(0, 32), lambda i: cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as integer) >> (15 - 5 * (i % 4)) & 31) as five from d)
select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes,
  array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from b
"""

_OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
g as (
  select distinct doc_id, array_to_string(ws[p:p+2], ' ') as k
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) as p from w where len(ws) > 0)),
s as (select doc_id, count(*) as n from g group by doc_id),
i as (select a.doc_id as u, b.doc_id as v, count(*) as i from g a join g b on a.k = b.k and a.doc_id <> b.doc_id group by all),
e as (select u, v from i join s x on x.doc_id = u join s y on y.doc_id = v where 100 * i >= 90 * (x.n + y.n - i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.v from r join e on r.b = e.u)
select a as doc_id, coalesce(any_value(n), 0) as n_shingles, min(b) as component_id
from r left join s on s.doc_id = a group by a
"""


_OP13_SQL = """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as s from documents),
g as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || substr(s, 1, 8) as bigint) as h1, cast('0x' || substr(s, 9, 8) as bigint) as h2,
  cast('0x' || substr(s, 17, 8) as bigint) as h3, cast('0x' || substr(s, 25, 8) as bigint) as h4 from h),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(t, 1, a) as x, substr(t, a + 1, b - a) as y, substr(t, b + 1) as z from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def _op11_sql() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _, _) in secrets.BASE.items()}
    run, letters, k = secrets.RUN, secrets.ALPHABET, len(secrets.ALPHABET)
    rest = "t"
    for p in quoted.values():
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    kinds = [*[(i, n, quoted[n], g, least) for i, (n, (_, g, least)) in enumerate(secrets.BASE.items())], (len(quoted), "markov", f"{run}{{{secrets.LEAST_RUN},}}", 0, 0)]
    found = "\n  union all ".join(
        f"select rid, {i} as k, '{n}' as kind, {least} as least, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {g}) as v, string_split_regex(t, '{p}') as s from d"
        for i, n, p, g, least in kinds
    )
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
x as ({found}),
y as (select rid, k, kind, least, m, v, s, unnest(range(1, len(m) + 1)) as i from x),
z as (select rid, k, kind, v[i] as value, length(m[i]) as n,
  list_sum(list_transform(s[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0) as start
  from y where length(v[i]) >= least),
o as (select distinct value from (select unnest(regexp_extract_all({rest}, '{run}{{{secrets.LEAST_TRAIN},}}')) as value from d) where length(value) < {secrets.LEAST_RUN}),
r0 as (select to_base64(unhex(sha256('key:' || i))) as raw, sha256('hex:' || i) as hex from range({secrets.MADE}) r(i)),
r1 as (select raw, hex, translate(raw, '+/=', '') as plain from r0),
q as (select distinct value from (
  select unnest([raw, plain, upper(plain), lower(plain), translate(raw, '+/=', '-_'), hex[1:40]]) as value from r1
  union all select unnest(regexp_extract_all(t, '{quoted["access"]}')) from d union all select unnest(regexp_extract_all(t, '{quoted["hex"]}')) from d)),
w as (select true as random, value from q union all select false, unnest(list_distinct([value, upper(value),
  replace(replace({list(secrets.JOINS)}[(length(value) + unicode(value)) % {len(secrets.JOINS)} + 1], '{{^}}', upper(value[1]) || value[2:]), '{{}}', value)])) from o),
b as (select random, value, unnest(range(1, length(value) + 1)) as i from w),
c as (select random, case when i = 1 then {k} else instr('{letters}', value[i-1]) - 1 end as a, instr('{letters}', value[i]) - 1 as b, count(*) as n from b group by all),
g as (select random, a, b, coalesce(n, 0) as n from (select unnest([true, false]) as random) cross join (select unnest(range({k + 1})) as a)
  cross join (select unnest(range({k})) as b) left join c using (random, a, b)),
l as (select random, a, b, ln((n + {secrets.BACKOFF} * (sum(n) over (partition by random, b) + 1) / (sum(n) over (partition by random) + {k}))
  / (sum(n) over (partition by random, a) + {secrets.BACKOFF})) as v from g),
e as (select a, b, sum(case when random then v else -v end) as ratio from l group by a, b),
u as (select distinct value from z where kind = 'markov'),
n as (select value, unnest(range(1, length(value) + 1)) as i from u),
j as (select value, sum(ratio) as total from n join e on e.a = case when i = 1 then {k} else instr('{letters}', value[i-1]) - 1 end and e.b = instr('{letters}', value[i]) - 1 group by value),
f as (select z.* from z left join j using (value) where kind <> 'markov'
  or (total > ln({secrets.ODDS}) and total > {secrets.LEAST_MEAN} * length(value)
    and not exists (select 1 from z as h where h.rid = z.rid and h.kind <> 'markov' and h.start + h.n = z.start + z.n))),
t as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
  count(*) filter (where kind = 'hex') as n_hex, count(*) filter (where kind = 'markov') as n_markov,
  string_agg(kind || ':' || start || ':' || (start + n), ',' order by start, k) as spans,
  string_agg(kind || ':' || start || ':' || (start + n), ',' order by start, k) filter (where kind <> 'markov') as base from f group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_markov, 0) as n_markov,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join t using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_secret_scan": _op11_sql(), "op13_fill_in_middle": _OP13_SQL, "op2_license_scan": _op2_sql(), "op7_line_dedup": _OP7_SQL, "op3_warc": _OP3_SQL, "op5_ngram_jaccard": _OP5_SQL, "op1_chat_format": _op1_sql(), "op4_quality_rules": _OP4_SQL, "op8_exact_dedup": _OP8_SQL}
