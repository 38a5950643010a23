"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.collocations import collocations
from quantloom.llm.common import cut, cut_path, digests, table
from quantloom.llm.decontaminate import contamination
from quantloom.llm import chat, language, mixing, quality, substring, trie, urlfilter, warc
from quantloom.llm.fingerprint import comparison
from quantloom.llm.secrets import BASE, secret_spans, spans_text
from quantloom.llm.simhash import near_duplicates


def _sha(c):
    return F.sha2(F.encode(c, "UTF-8"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), _sha(ids).alias("items_sha256"), "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cut_path(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages")), path)
    headers = cut(warc.read(spark, path).drop("payload"))  # archives are parsed once
    found = warc.resolved(warc.captures(headers))
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] <= len(BASE))
    return found.select("doc_id", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in BASE], _sha(spans_text(base)).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparison(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3).select("doc_id", "fingerprint", "component_id")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judged(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False))
    model = language.model_of(docs.where(~held))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    stats = cut(stats.withColumn("held_out", F.coalesce(language.fold("doc_id", 5) == 0, F.lit(False))))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fitted(stats.where("not held_out").join(labels, "doc_id"))
    return quality.scored(stats, model).select("doc_id", "held_out", "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % 100; all of them (conv)."""
    convs = t.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % 6, "base": F.col("conv") - F.col("conv") % 100})
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut(convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv", "base", "h", taken.alias("taken")))
    own = t.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "key", "chars")
    lead = t.where("conv % 100 = 0 and pos < 5").withColumnRenamed("conv", "base").join(convs, "base").where("pos < h").select("conv", "pos", "key", "chars")
    return own.union(lead), convs.select("conv")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = trie.trie(*_rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))
    # ids in their order, some 512 a row, so that no node's members meet in one row
    ranged = trie.numbered(ends.repartitionByRange("conv").sortWithinPartitions("conv"), "place").withColumn("chunk", F.floor(F.col("place") / 512))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ids = ranged.groupBy("conv_id", "depth", "chunk").agg(ids.alias("ids"))
    first = ids.groupBy("conv_id", "depth").agg(F.min("chunk").alias("first"))
    ids = ids.join(first, ["conv_id", "depth"]).withColumn("ends_sha256", F.concat(F.when(F.col("chunk") > F.col("first"), ",").otherwise(""), "ids"))
    found = digests(ids, ["conv_id", "depth"], ["chunk"], {"ends_sha256": F.col("ends_sha256")}).drop("n")
    return nodes.join(found, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def _chat_records(turns: DataFrame) -> DataFrame:
    """conv_id, turn, record: each row as JSON, in one of four layouts that chats come in."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    json = lambda *fields: F.to_json(F.struct(*fields))
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    kind = F.when(role.isin("system", "user", "assistant"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))).otherwise(0)
    record = (
        F.when(kind == 0, json(role.alias("role"), text.alias("text")))
        .when(kind == 1, json(speaker.alias("from"), text.alias("value")))
        .when(kind == 2, json(F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message")))
        .when(role == "user", json(text.alias("user")))
        .when(role == "system", json(text.alias("system")))
        .otherwise(json(text.alias("assistant")))
    )
    return turns.select("conv_id", "turn", record.alias("record"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical(_chat_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))
    made = chat.formatted(turns).select("conv_id", "turn", "formatted", "mask_start", "mask_end")
    texts = {"turns_sha256": F.concat(chat.role_of(), F.lit("\n"), chat.text_of(), F.lit("\n")), "loss_sha256": chat.learned()}
    sums = {"loss_chars": F.char_length(chat.learned()), "formatted_chars": F.char_length("formatted")}
    found = digests(made, ["conv_id"], ["turn", "formatted"], texts, sums)
    return found.select("conv_id", F.col("n").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') seq from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') seq from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, ns where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.seq = bw.seq and dw.n = bw.n),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hits group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join its using (doc_id)
"""

ORACLES["op2_warc"] = r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint payload_bytes, sha1(h) payload_digest from p),
g as (select payload_digest, max(page_id) first, count(*) n from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, d.payload_digest,
       case when n > 1 and page_id <> first and payload_bytes >= 1000 then 'revisit' else 'response' end record_type,
       case when n > 1 and page_id <> first and payload_bytes >= 1000 then first end refers_to
from d left join g using (payload_digest)
"""

ORACLES["op6_url_filters"] = r"""
with s as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end r from pages),
t as (select page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) path from s),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select page_id, h || p rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) k from t join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select t.page_id, host, path, rule, coalesce(v, 'allow') verdict from t left join (select * from m where k = 1) m using (page_id)
"""

ORACLES["op7_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') seq from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
firsts as (select seq, min(doc_id) least from win group by 1 having count(distinct doc_id) > 1),
covered as (select distinct doc_id, unnest(range(i, i + 13)) p from win join firsts using (seq) where doc_id > least),
words as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) kept, count(*) n from words left join covered using (doc_id, p) where covered.p is null group by 1)
select d.doc_id, len(d.w)::bigint n_words, (len(d.w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join kept using (doc_id)
"""

ORACLES["op11_collocations"] = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
total as (select lang, sum(len(w))::bigint n from w group by 1),
f as (select lang, phrase, count(*)::bigint a, any_value(size) size from (select lang, size, array_to_string(w[i:i + size - 1], ' ') phrase from (select lang, w, size, unnest(range(1, len(w) - size + 2)) i from w, (select unnest(range(1, 5)) size) where len(w) >= size)) group by 1, 2 having count(*) >= 30),
c as (select * from f where size > 1),
cuts as (select c.lang, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') x, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') y from (select *, unnest(range(1, size)) k from c) c),
s as (select cuts.lang, cuts.phrase, cuts.a, k, fx.a l, fy.a r, (cuts.a::hugeint * 2000000) // (fx.a::hugeint + fy.a::hugeint) score from cuts join f fx on fx.lang = cuts.lang and fx.phrase = x join f fy on fy.lang = cuts.lang and fy.phrase = y),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
sub as (select lang, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') phrase, max(a) longer from (select *, unnest(range(1, size - n + 2)) i from (select *, unnest(range(2, size)) n from c where size > 2)) group by 1, 2),
good as (select low.* from low left join sub using (lang, phrase) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from good)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join total using (lang) where rank <= 2000
"""

ORACLES["op12_conversation_trie"] = r"""
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 pos, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
s as (select c, count(*) n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::varchar, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 h, c - c % 100 b from t group by c),
k as (select s.c, s.h, s.b, least(s.h, coalesce(o.n, 0)) taken from s left join s o on o.c = s.b),
rows_ as (select t.c, taken + pos - h pos, r, x from t join k using (c) where pos >= h union all select k.c, pos, r, x from k join t on t.c = k.b where pos < h),
p as (select c, pos + 1 d, length(x) chars, string_agg(sha256(length(r)::varchar || ':' || r || x), '') over (partition by c order by pos) key from rows_),
root as (select min(c) c0, count(*) n from s),
m as (select p.*, min(c) over (partition by d, key) top, count(*) over (partition by d, key) n from p),
spot as (select c, d, top from m union all select c, 0, c0 from s, root),
node as (select m.top, m.d, m.n, chars, spot.top parent from m join spot on spot.c = m.c and spot.d = m.d - 1 where m.c = m.top union all select c0, 0, n, 0, null from root),
kids as (select parent top, d - 1 d, count(*) n_children from node where d > 0 group by 1, 2),
sub as (select spot.top, spot.d, sum(case when kids.top is null then 1 else 0 end) leaves, sum((u.n - 1) * u.chars) saved from node u left join kids on kids.top = u.top and kids.d = u.d join spot on spot.c = u.top and spot.d <= u.d group by 1, 2),
len as (select s.c, coalesce(max(p.d), 0) d from s left join p using (c) group by 1),
ends as (select spot.top, spot.d, string_agg(spot.c::varchar, ',' order by spot.c) ids from len join spot using (c, d) group by 1, 2)
select node.top conv_id, node.d depth, parent parent_conv_id, node.n n_convs, coalesce(n_children, 0)::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from node join sub on sub.top = node.top and sub.d = node.d left join kids on kids.top = node.top and kids.d = node.d left join ends on ends.top = node.top and ends.d = node.d
"""

ORACLES["op13_chat_format"] = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
e as (select *, regexp_replace(x, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|(?:im_start|im_end|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id)\|>))', '\1\\\2', 'g') escaped from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first)) turns_sha256,
       coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first) filter (r = 'assistant'), '')) loss_sha256,
       sum(12 + length(r) + 1 + length(escaped) + 11)::bigint formatted_chars
from e group by conv_id
"""
