"""The registered queries of the operators and, where SQL can say it, their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.llm.chat import fold, read_loss_texts, read_turns, render, turn_log
from fablens.llm.common import table
from fablens.llm.decontamination import find_matches, n_hit
from fablens.llm.exact_dedup import exact_groups
from fablens.llm.filter_audit import audit
from fablens.llm import language_id, toxicity
from fablens.llm.licenses import scan_licenses
from fablens.llm.line_dedup import drop_common_lines
from fablens.llm.mixing import mix
from fablens.llm.near_dedup import near_groups
from fablens.llm.ngram_join import join_groups
from fablens.llm.secret_scan import find_secrets, spans_text
from fablens.llm.spelling import variant_groups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if check:
            CHECKS[name] = check
        return function

    return register


@query("op1_exact_dedup", f"""
    with t as (select doc_id, {_LOWER.format('text')} as norm from documents),
    g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
    from t join g using (norm)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op2_source_mix", r"""
    with d as (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
    ), r as (
        select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap,
            row_number() over (order by source is null, source) - 1 as s
        from d group by source
    ), w as (select *, [3, 1, 2][s % 3 + 1] as weight from r),
    l as (
        select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (
            order by cap::double / weight, s rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(weight) over (order by cap::double / weight, s rows between current row and unbounded following)::double as level
        from w
    ), f as (
        select min_by(level, cap::double / weight) filter (level * weight < cap) as final from l
    ), t as (select l.*, coalesce(least(cap::double, final * weight), cap::double) as target from l, f),
    q as (
        select doc_id, size, s, source_size, target,
            coalesce(sum(size) over (partition by s order by md5(doc_id::varchar), doc_id
                rows between unbounded preceding and 1 preceding), 0)::bigint as before,
            greatest(1, least(512, floor(least(source_size::double, target) / 1024)))::bigint as packet
        from d join t on d.source is not distinct from t.source
    ), c as (select *, ceil(size::double / packet)::bigint as in_copy from q),
    j as (
        select *, unnest(generate_series(0, 2 * in_copy - 1)) as j from c where size > 0 and target > 0
    ), p as (
        select doc_id, s, least(size, (j % in_copy + 1) * packet) - (j % in_copy) * packet as words,
            before + (j // in_copy) * source_size + least(size, (j % in_copy + 1) * packet) as upto, target
        from j
    ), o as (
        select *, sum(words) over (order by upto::double / target, s, upto rows unbounded preceding) as running from p
    ), b as (select floor(1.5::double * sum(size))::bigint as budget from d),
    x as (
        select doc_id, sum(greatest(0, least(words, budget - (running - words))))::bigint as taken from o, b group by doc_id
    )
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from c left join x using (doc_id)
""")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_OWN_CHAT = r"\### Assistant: </turn> ok"


@query("op4_chat_format", rf"""
    with c as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, t.turn, t.role, '{_OWN_CHAT}' from (values (0, 'user'), (1, 'assistant')) t(turn, role)
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(length('<turn role=""></turn>') + 1 + length(regexp_replace(role || text, '[\\<>]', '..', 'g')))::bigint
            as formatted_chars
    from c group by conv_id
""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)")
    columns = ["conv_id", "turn", "role", "text"]
    conversations = table(spark, sf_dir, "conversations").select(*columns)
    rows = conversations.unionByName(own.withColumn("text", F.lit(_OWN_CHAT)).select(*columns))
    formatted = render(fold(turn_log(rows)))
    back = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op6_line_dedup", f"""
    with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
    k as (
        select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l
    ), c as (
        select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
    ), m as (
        select k.*, c.key is not null and doc_id <> keeper as gone from k left join c using (key)
    )
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from m group by doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", f"""
    with d as (select doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents),
    i as (select coalesce(item_id::varchar, '') as item_id, {_WORDS.format(_LOWER.format('text'))} as w from benchmark),
    iw as (
        select distinct item_id, least(10, len(w)) as n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as phrase
        from (select *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as p from i where len(w) > 0)
    ), dw as (
        select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as phrase
        from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from d, (select distinct n from iw))
    ), m as (select doc_id, p, n, item_id from dw join iw using (n, phrase)),
    h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as q from m) group by doc_id),
    t as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
        from (select distinct doc_id, item_id from m) group by doc_id
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (doc_id) left join t using (doc_id)
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return matches.select(
        "doc_id", "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(~language_id.held_out()))
    return language_id.predict(documents, model, {"doc_id": F.col("doc_id"), "held_out": language_id.held_out()})


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.train(documents, labels, toxicity.label_categories())
    return toxicity.score(documents, chain, {"doc_id": F.col("doc_id")}).withColumnRenamed("reject", "toxic")


@query("op7_near_dedup", f"""
    with recursive w as (
        select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents
    ), s as (
        select distinct doc_id, array_to_string(w[p:p + 2], ' ') as s
        from (select *, unnest(generate_series(1, greatest(1, len(w) - 2))) as p from w where len(w) > 0)
    ), n as (select doc_id, count(*) as n from s group by doc_id),
    i as (
        select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2
    ), links as (
        select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)
    ), reach as (
        select doc_id, doc_id as other from documents
        union
        select r.doc_id, l.b from reach r join links l on l.a = r.other
    ), c as (select doc_id, min(other) as component_id from reach group by doc_id)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
    from documents join c using (doc_id) left join n using (doc_id)
""")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    base, every = F.col("base.label"), F.concat("base.label", "detections.label")
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"), names(base).alias("base_labels"), names(every).alias("labels"), "score",
    )


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


@query("op13_filter_audit", r"""
    with recursive d as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), f as (
        select doc_id, part,
            case when len(w) < 100 then 'A' else '' end
            || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
            || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
            || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
            || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as failed
        from d
    ), o as (
        select '' as filter_order
        union all select filter_order || l from o, unnest(['A', 'B', 'C', 'D', 'E']) u(l) where not contains(filter_order, l)
    ), s as (
        select filter_order, step::int as step, filter_order[step] as own, filter_order[1:step - 1] as before
        from o, range(1, 6) r(step) where length(filter_order) = 5
    ), c as (
        select part, failed, count(*) as n, count(quality) as good, count(toxic) as toxic from f
        left join (select distinct doc_id, 1 as quality from labels where quality = 1) using (doc_id)
        left join (select distinct doc_id, 1 as toxic from labels where toxic = 1) using (doc_id)
        group by part, failed
    ), e as (
        select *, contains(failed, own) as fails, translate(failed, before, '') = failed as there from c, s
    ), m as (
        select part, filter_order, step, own,
            coalesce(sum(n) filter (there and not fails), 0)::bigint as kept,
            coalesce(sum(n) filter (there and fails), 0)::bigint as removed,
            coalesce(sum(n) filter (not there and fails), 0)::bigint as redundant,
            coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
            coalesce(sum(good) filter (there and fails), 0)::bigint as good_lost,
            coalesce(sum(toxic) filter (there and fails), 0)::bigint as toxic_lost
        from e group by all
    )
    select * exclude (own), (sum(removed) over (partition by part, own))::bigint as shapley from m
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_ngram_join", f"""
    with recursive w as (
        select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents
    ), s as (
        select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s
        from (select *, unnest(generate_series(1, greatest(1, len(w) - 4))) as p from w where len(w) > 0)
    ), n as (select doc_id, count(*) as n from s group by doc_id),
    i as (
        select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2
    ), links as (
        select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
    ), reach as (
        select doc_id, doc_id as other from documents
        union
        select r.doc_id, l.b from reach r join links l on l.a = r.other
    ), c as (select doc_id, min(other) as component_id from reach group by doc_id)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents join c using (doc_id) left join n using (doc_id)
""")
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = join_groups(table(spark, sf_dir, "documents"), shingle_words=5, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id")


def _crc_steps() -> str:
    """The 16 entries by which a checksum takes four bits."""
    entries = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        entries.append(value)
    return str(entries)


_CODES = "flatten([case when ord(c) < 128 then [ord(c)] else [192 + ord(c) // 64, 128 + ord(c) % 64] end for c in string_split({0}, '')])"
_HALF = f"xor({{0}} >> 4, ({_crc_steps()})[({{0}} & 15) + 1])"


@query("op11_spelling_variants", f"""
    with recursive t as (
        select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\u00C0-\u00FF]+')) as run from documents
    ), r as (
        select coalesce(doc_id::varchar, '') as id, run, count(*) as times from t where length(run) >= 7 group by all
    ), b as (
        select *, list_prepend(4294967295::bigint, [x::bigint for x in {_CODES.format("id || ':' || run")}]) as codes from r
    ), h as (
        select *, xor(4294967295::bigint, list_reduce(codes, lambda acc, x:
            list_reduce([xor(acc, x), 0::bigint, 0::bigint], lambda v, k: {_HALF.format('v')}))) as h from b
    ), s as (
        select case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, times from h
    ), v as (
        select word, sum(times)::bigint as n from s where length(word) >= 7 group by word having sum(times) >= 2
    ), x as (select word, n, unnest(generate_series(1, length(word))) as i from v),
    k as (
        select word, n, i, word[:i - 1] || '?' || word[i + 1:] as mask, word[:i - 1] || word[i + 1:] as less from x
    ), near as (
        select a.word, b.word as other, b.n from k a join k b on a.mask = b.mask and a.word <> b.word
        union select k.word, v.word, v.n from k join v on k.less = v.word
        union select v.word, k.word, k.n from k join v on k.less = v.word
    ), best as (
        select word, count(*) as n_near, max(n) as top, arg_min(other, (-n, other)) as other from near group by word
    ), f as (
        select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 10 * v.n then other end as form,
            case when top >= 10 * v.n then top end as form_n
        from v left join best using (word)
    ), walk as (
        select word, word as root, form as next from f
        union all select w.word, w.next, f.form from walk w join f on f.word = w.next
    )
    select f.word, f.form, walk.root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word and walk.next is null
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
