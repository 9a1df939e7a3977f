"""DuckDB SQL for the queries, as chains of common table expressions written independently of the operators."""

from __future__ import annotations

from glossaria.constants import ARABIC_FAMILY_ISO, CATEGORIES, CATEGORY_ALIASES, CLUSTERS, HIGH_RISK_LABELS, HINDI_CLUSTER, HINDI_RELATED_ISO, INDIC_AUDIT_ISO, LEGACY_WEIGHTS, ROMANCE_ISO, ROMANIZED_HINDI_KEYWORDS, ROMANIZED_INDIC_KEYWORDS, SEGMENT_WEIGHTS, SOURCE_HINDI_CODES, SOURCE_INDIC_CODES
from glossaria.operators.panel import NO_METADATA, PROMPT_DESCRIPTIONS, PROMPT_HEAD, PROMPT_NOTE, PROMPT_TITLES
from glossaria.plans.queries import MODELS, SEED, WORDS_A, WORDS_B


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _n(pattern: str, c: str = "clean_text") -> str:
    return f"CAST(len(regexp_extract_all({c}, '{pattern}')) AS INTEGER)"


def _words(ws: list[str]) -> str:
    return r"\b(" + "|".join(sorted(ws, key=lambda w: (-len(w), w))) + r")\b"


_URL = r"(?i)https?://\S+|www\.\S+"
_SCRIPTS = {"latin": r"\p{Latin}", "devanagari": r"\p{Devanagari}", "arabic": r"\p{Arabic}", "cyrillic": r"\p{Cyrillic}", "han": r"\p{Han}", "kana": r"[\p{Hiragana}\p{Katakana}]", "hangul": r"\p{Hangul}", "thai": r"\p{Thai}"}
_ALL = [*_SCRIPTS, "other"]
_MOST = "greatest(" + ", ".join(f"{s}_char_count" for s in _ALL) + ")"
_CLUSTER_ROWS = _values([(k, n) for n, ks in CLUSTERS.items() for k in ks])
_ASCII = "regexp_replace(lower(text), '[^\\x00-\\x7F]', 'x', 'g')"


def _same(x: str, y: str) -> str:
    return f"coalesce({x} = {y}, false)"


def _weight(table: dict[str, float]) -> str:
    return "CASE segment_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END"


def _sum(c: str, where: str = "true") -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,9))) FILTER ({where}) AS DOUBLE)"


def _mean(where: str) -> str:
    n = f"count(score) FILTER ({where})"
    return f"CASE WHEN {n} > 0 THEN (2 * sum(CAST(round(score * 1000000) AS BIGINT)) FILTER ({where}) + {n}) // (2 * {n}) / 1000000 END"


def _hash(*cs: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in cs) + ")"


def _bucket(n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(channel_id), 1, 8) AS BIGINT) % {n} AS INTEGER)"


def _canon(c: str) -> str:
    return f"CASE WHEN {c} IN {_in(ARABIC_FAMILY_ISO)} THEN 'ara' ELSE {c} END"


_PIVOT = ", ".join(
    f"max({c}) FILTER (language_rank = {r}) AS {p}_{n}"
    for r, p, cs in ((1, "primary", (("label", "label"), ("iso639_3", "iso"), ("script", "script"), ("weighted_score", "score"), ("top1_weighted_score", "top1_score"))), (2, "secondary", (("label", "label"), ("iso639_3", "iso"), ("script", "script"), ("weighted_score", "score"), ("segment_count", "segment_count"), ("top1_segment_count", "top1_segment_count"), ("segment_type_count", "type_count"), ("mean_segment_score", "mean"), ("max_segment_score", "max"))))
    for c, n in cs
)
_SIDE = ["valid_segment_count", "valid_type_count", "primary_label", "primary_iso", "primary_script", "primary_score", "vote_share", "secondary_label", "secondary_iso", "secondary_script", "secondary_segment_count", "secondary_top1_segment_count", "secondary_type_count", "secondary_mean", "secondary_max", "secondary_ratio", "secondary_margin_ratio"]

# the first rule that fits: condition, status, label, cluster, rollup, manual
_RA, _RB = "coalesce(a_vote_share, 0)", "coalesce(b_vote_share, 0)"
_ROLL = {p: f"coalesce({p}_primary_cluster, {p}_primary_iso)" for p in "ab"}
_EITHER = "coalesce(a_primary_cluster, b_primary_cluster)"
_RULES = [
    ("a_primary_label IS NULL AND b_primary_label IS NULL", "insufficient_text", "NULL", "NULL", "NULL", "false"),
    (f"a_primary_label = b_primary_label AND a_primary_high_risk AND {_RA} >= 0.65 AND {_RB} >= 0.65", "high_risk_tail_exact_agreement", "a_primary_label", "a_primary_cluster", _ROLL["a"], "false"),
    ("a_primary_label = b_primary_label AND a_primary_high_risk", "high_risk_tail_label_needs_review", "NULL", "a_primary_cluster", _ROLL["a"], "true"),
    ("a_primary_label = b_primary_label", "exact_model_agreement", "a_primary_label", "a_primary_cluster", _ROLL["a"], "false"),
    (f"b_primary_label IS NULL AND {_RA} >= 0.65 AND NOT a_primary_high_risk", "openlid_high_confidence_glotlid_missing_or_error", "a_primary_label", "a_primary_cluster", _ROLL["a"], "false"),
    ("b_primary_label IS NULL", "openlid_high_confidence_glotlid_missing_or_error", "NULL", "a_primary_cluster", _ROLL["a"], "true"),
    (f"a_primary_label IS NULL AND {_RB} >= 0.65 AND NOT b_primary_high_risk", "glotlid_fallback_openlid_low_confidence", "b_primary_label", "b_primary_cluster", _ROLL["b"], "false"),
    ("a_primary_label IS NULL", "model_disagreement_needs_review", "NULL", "NULL", "NULL", "true"),
    (f"a_primary_iso IN {_in(ARABIC_FAMILY_ISO)} AND b_primary_iso IN {_in(ARABIC_FAMILY_ISO)}", "taxonomy_normalized_agreement", "'ara_Arab'", _EITHER, "'ara'", "false"),
    ("a_primary_high_risk OR b_primary_high_risk", "high_risk_tail_label_needs_review", "NULL", "NULL", "NULL", "true"),
    ("a_primary_iso = b_primary_iso", "iso_or_script_variant_agreement", "NULL", _EITHER, "coalesce(a_primary_cluster, b_primary_cluster, a_primary_iso)", "false"),
    ("a_primary_cluster = b_primary_cluster", "cluster_model_agreement", "NULL", "a_primary_cluster", "a_primary_cluster", "false"),
    (f"{_RA} < 0.50 AND {_RB} >= 0.65", "glotlid_fallback_openlid_low_confidence", "b_primary_label", "b_primary_cluster", _ROLL["b"], "false"),
    ("true", "model_disagreement_needs_review", "NULL", "NULL", "NULL", "true"),
]


def _pick(k: int) -> str:
    v = lambda r: f"'{r[1]}'" if k == 1 else r[k]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {v(r)}" for r in _RULES) + " END"


def _z(c: str) -> str:
    return f"coalesce({c}, 0)"


def _credible(p: str) -> str:
    return f"{p}_secondary_label IS NOT NULL AND {_z(p + '_secondary_ratio')} >= 0.50 AND {_z(p + '_secondary_segment_count')} >= 3 AND {_z(p + '_secondary_top1_segment_count')} >= 1 AND {_z(p + '_secondary_mean')} >= 0.45 AND ({_z(p + '_secondary_max')} >= 0.70 OR {p}_cross) AND {_z(p + '_secondary_margin_ratio')} >= 0.25 AND ({p}_cross OR {_z(p + '_secondary_type_count')} >= 2) AND NOT {p}_samec AND NOT ({p}_secondary_high_risk AND NOT agree_exact_secondary)"


def _peer(p: str, q: str) -> str:
    return f"({p}_credible AND {p}_cross AND ({q}_secondary_cluster IS NULL OR {_same(q + '_secondary_cluster', p + '_secondary_cluster')}))"


_CHAIN: list[tuple[str, str]] = [
    ("vid", "SELECT CASE WHEN length(text) < 50 THEN 'short/' || CAST(doc_id % 10 AS VARCHAR) ELSE source || '/' || CAST((doc_id // 100) % 10 AS VARCHAR) END AS channel_id, CAST(doc_id AS VARCHAR) AS video_id, substr(text, 1, 80) AS title, text, lang FROM documents"),
    ("uni", "SELECT channel_id, CASE WHEN min(lang) = max(lang) THEN CASE min(lang) WHEN 'de' THEN 'hi' ELSE min(lang) END END AS source_language FROM vid GROUP BY channel_id"),
    ("seg0", "SELECT channel_id, video_id, 'video_title' AS segment_type, substr(title, 1, 2000) AS text FROM vid UNION ALL SELECT channel_id, video_id, 'video_description', substr(text, 1, 2000) FROM vid UNION ALL SELECT channel_id, video_id, 'video_tags', substr(lang, 1, 2000) FROM vid"),
    ("seg", "SELECT *, sha256(concat_ws('||', channel_id, coalesce(video_id, ''), segment_type, text)) AS segment_id FROM seg0 WHERE channel_id IS NOT NULL AND trim(text) <> ''"),
    ("cl", rf"SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(translate(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(13) || chr(10), '  ')), '{_URL}', ' ', 'g'), '\s\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\p{{Zs}}]|\d', '', 'g'), '\s\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^$', '', 'g') AS clean_text FROM seg"),
    ("c1", "SELECT *, CAST(length(text) AS INTEGER) AS raw_text_len, CAST(length(clean_text) AS INTEGER) AS clean_text_len, CAST(CASE WHEN clean_text = '' THEN 0 ELSE len(regexp_split_to_array(clean_text, '\\s+')) END AS INTEGER) AS clean_token_count, " + _n(r"\p{L}") + " AS clean_letter_count, " + ", ".join(f"{_n(p)} AS {s}_char_count" for s, p in _SCRIPTS.items()) + " FROM cl"),
    ("c2", "SELECT *, greatest(0, clean_letter_count - (" + " + ".join(f"{s}_char_count" for s in _SCRIPTS) + ")) AS other_char_count FROM c1"),
    ("c3", f"SELECT *, CASE WHEN clean_letter_count = 0 THEN 'none' " + " ".join(f"WHEN {s}_char_count = {_MOST} THEN '{s}'" for s in _ALL) + f" END AS dominant_script, CASE WHEN clean_letter_count > 0 THEN {_MOST} / clean_letter_count ELSE 0.0 END AS dominant_script_share FROM c2"),
    ("m", rf"SELECT *, regexp_matches(text, '{_URL}') AS has_url, regexp_matches(text, '#[\p{{L}}\p{{M}}\p{{N}}_]+') AS has_hashtag, regexp_matches(text, '[\p{{So}}\p{{Sk}}\p{{Sc}}\p{{Sm}}]') AS has_emoji_or_symbol, clean_letter_count >= 40 AS is_valid_latin_rule, dominant_script NOT IN ('latin', 'none') AND clean_letter_count >= 12 AND dominant_script_share >= 0.60 AS is_valid_non_latin_rule FROM c3"),
    ("met", "SELECT *, is_valid_latin_rule OR is_valid_non_latin_rule AS is_valid, CASE WHEN is_valid_latin_rule OR is_valid_non_latin_rule THEN NULL WHEN clean_letter_count = 0 THEN 'no_letters' WHEN dominant_script IN ('latin', 'none') THEN 'below_min_clean_chars_latin_or_mixed' WHEN clean_letter_count < 12 THEN 'below_min_clean_chars_non_latin' WHEN dominant_script_share < 0.60 THEN 'low_dominant_script_share' ELSE 'invalid_other' END AS short_text_reason FROM m"),
    ("val", r"SELECT row_number() OVER () AS rid, channel_id, segment_id, segment_type, clean_letter_count, regexp_split_to_array(clean_text, '[^\p{L}]+') AS w FROM met WHERE is_valid"),
    ("lists", "SELECT * FROM (VALUES " + _values([(m, lab, w) for m, ls in (("a", WORDS_A), ("b", WORDS_B)) for lab, ws in ls.items() for w in ws]) + ") t(lid_model, label_raw, word)"),
    ("hit", "SELECT rid, lid_model, label_raw, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM val) JOIN lists USING (word) GROUP BY ALL"),
    ("rnk", "SELECT *, row_number() OVER (PARTITION BY rid, lid_model ORDER BY n DESC, label_raw) AS r, round(n / sum(n) OVER (PARTITION BY rid, lid_model), 6) AS score FROM hit"),
    ("lng", "SELECT channel_id, segment_id, segment_type, mm.lid_model, CAST(r AS INTEGER) AS prediction_rank, label_raw, label_raw AS label, split_part(label_raw, '_', 1) AS iso639_3, split_part(label_raw, '_', 2) AS script, score, max(score) FILTER (r = 1) OVER (PARTITION BY val.rid, mm.lid_model) AS score_1, clean_letter_count FROM val CROSS JOIN (VALUES ('a'), ('b')) mm(lid_model) LEFT JOIN (SELECT * FROM rnk WHERE r <= 5) k ON k.rid = val.rid AND k.lid_model = mm.lid_model"),
    ("adm", f"SELECT *, score * ({_weight(SEGMENT_WEIGHTS)}) * CASE WHEN prediction_rank = 1 THEN 1.0 ELSE 0.2 END AS weighted_score FROM lng WHERE label IS NOT NULL AND NOT regexp_matches(lower(label), '^(zxx|und|noise|null|none|unknown)') AND ((prediction_rank = 1 AND score >= 0.20) OR (prediction_rank = 2 AND score >= 0.35 AND score_1 > 0 AND score / score_1 >= 0.50))"),
    ("cv0", f"SELECT channel_id, lid_model, label, iso639_3, script, {_sum('weighted_score')} AS weighted_score, {_sum('weighted_score', 'prediction_rank = 1')} AS top1_weighted_score, count(DISTINCT segment_id) AS segment_count, count(DISTINCT segment_id) FILTER (prediction_rank = 1) AS top1_segment_count, count(DISTINCT segment_id) FILTER (prediction_rank <> 1) AS top2_segment_count, count(*) AS vote_count, {_mean('true')} AS mean_segment_score, max(score) AS max_segment_score, {_mean('prediction_rank = 1')} AS top1_mean_score, max(score) FILTER (prediction_rank = 1) AS top1_max_score, array_to_string(list_sort(list(DISTINCT segment_type)), ',') AS segment_types, CAST(count(DISTINCT segment_type) AS INTEGER) AS segment_type_count FROM adm GROUP BY ALL"),
    ("cv", "SELECT *, CAST(row_number() OVER (PARTITION BY channel_id, lid_model ORDER BY weighted_score DESC, segment_count DESC, max_segment_score DESC, label) AS INTEGER) AS language_rank FROM cv0"),
    ("pv", f"SELECT channel_id, lid_model, {_PIVOT}, max(weighted_score) FILTER (language_rank = 3) AS third_score, {_sum('weighted_score')} AS total_score, {_sum('top1_weighted_score')} AS total_top1 FROM cv GROUP BY ALL"),
    ("tot", "SELECT channel_id, lid_model, count(DISTINCT segment_id) AS valid_segment_count, count(DISTINCT segment_type) AS valid_type_count, CAST(sum(clean_letter_count) AS BIGINT) AS total_letters FROM val CROSS JOIN (VALUES ('a'), ('b')) mm(lid_model) GROUP BY ALL"),
    ("sm", "SELECT *, CASE WHEN total_score > 0 THEN round(primary_score / total_score, 9) END AS vote_share, CASE WHEN total_top1 > 0 THEN round(primary_top1_score / total_top1, 9) END AS top1_vote_share, CASE WHEN primary_score > 0 THEN round(secondary_score / primary_score, 9) END AS secondary_ratio, CASE WHEN secondary_score > 0 THEN round((secondary_score - coalesce(third_score, 0)) / secondary_score, 9) END AS secondary_margin_ratio FROM tot LEFT JOIN pv USING (channel_id, lid_model)"),
    ("clu", f"SELECT * FROM (VALUES {_CLUSTER_ROWS}) t(key, cluster)"),
    ("cm0", "SELECT coalesce(x.channel_id, y.channel_id) AS channel_id, " + ", ".join(f"{t}.{c} AS {p}_{c}" for p, t in (("a", "x"), ("b", "y")) for c in _SIDE) + ", x.channel_id IS NOT NULL AS a_present, y.channel_id IS NOT NULL AS b_present FROM (SELECT * FROM sm WHERE lid_model = 'a') x FULL JOIN (SELECT * FROM sm WHERE lid_model = 'b') y ON x.channel_id = y.channel_id"),
    ("cm1", "SELECT *, " + ", ".join(f"coalesce((SELECT cluster FROM clu WHERE key = {p}_{r}_label), (SELECT cluster FROM clu WHERE key = {p}_{r}_iso)) AS {p}_{r}_cluster, coalesce({p}_{r}_label IN {_in(HIGH_RISK_LABELS)}, false) AS {p}_{r}_high_risk" for p in "ab" for r in ("primary", "secondary")) + " FROM cm0"),
    ("cm", f"SELECT *, {_same('a_primary_label', 'b_primary_label')} AS agree_exact_primary, {_same(_canon('a_primary_iso'), _canon('b_primary_iso'))} AS agree_iso_primary, {_same('a_primary_script', 'b_primary_script')} AS agree_script_primary, {_same('a_primary_cluster', 'b_primary_cluster')} AS agree_cluster_primary, {_same('a_secondary_label', 'b_secondary_label')} AS agree_exact_secondary, {_same('a_secondary_cluster', 'b_secondary_cluster')} AS agree_cluster_secondary FROM cm1"),
    ("co", f"SELECT *, {_pick(1)} AS consensus_status, {_pick(2)} AS consensus_label, {_pick(3)} AS consensus_cluster, {_pick(4)} AS consensus_rollup, {_pick(5)} AS requires_manual FROM cm"),
    ("cs", "SELECT *, split_part(consensus_label, '_', 1) AS consensus_iso, CASE WHEN contains(consensus_label, '_') THEN split_part(consensus_label, '_', 2) END AS consensus_script, CASE WHEN consensus_status = 'taxonomy_normalized_agreement' THEN 'taxonomy_normalized' WHEN consensus_status = 'high_risk_tail_exact_agreement' THEN 'fasttext_tail_agreement' WHEN requires_manual THEN 'manual_adjudication_required' WHEN consensus_status <> 'insufficient_text' THEN 'fasttext_agreement' ELSE 'fasttext_unlabeled_consensus' END AS consensus_source FROM co"),
    ("mx0", "SELECT *, " + ", ".join(f"coalesce({p}_secondary_script <> {p}_primary_script, false) AS {p}_cross, {_same(f'{p}_secondary_cluster', f'{p}_primary_cluster')} AS {p}_samec, {p}_secondary_label IS NOT NULL AND {_z(p + '_secondary_ratio')} >= 0.40 AND {_z(p + '_secondary_segment_count')} >= 2 AS {p}_screen" for p in "ab") + " FROM cs"),
    ("mx1", f"SELECT *, {_credible('a')} AS a_credible, {_credible('b')} AS b_credible, a_screen OR b_screen AS mixed_screen FROM mx0"),
    ("mx2", f"SELECT *, a_present AND b_present AND ((agree_exact_secondary AND (a_credible OR b_credible)) OR (agree_cluster_secondary AND (a_credible OR b_credible)) OR {_peer('a', 'b')} OR {_peer('b', 'a')}) AS mixed_credible FROM mx1"),
    ("mx", "SELECT *, CASE WHEN mixed_credible THEN NULL WHEN NOT mixed_screen THEN 'no_model_screen' WHEN (a_secondary_high_risk OR b_secondary_high_risk) AND NOT agree_exact_secondary THEN 'high_risk_secondary_without_model_agreement' WHEN (a_screen AND a_samec) OR (b_screen AND b_samec) THEN 'secondary_same_analysis_cluster_as_primary' WHEN a_credible OR b_credible THEN 'no_cross_model_secondary_support' ELSE 'insufficient_secondary_evidence' END AS mixed_rejection_reason FROM mx2"),
    ("kw", f"SELECT *, CAST(len(regexp_extract_all({_ASCII}, '{_words(ROMANIZED_HINDI_KEYWORDS)}')) AS INTEGER) AS hindi_keyword_count, regexp_extract_all({_ASCII}, '{_words(ROMANIZED_INDIC_KEYWORDS)}') AS found FROM met"),
    ("kx", "SELECT channel_id, list_sort(list(DISTINCT f)) AS ex FROM (SELECT channel_id, unnest(found) AS f FROM kw) GROUP BY channel_id"),
    ("ft0", "SELECT channel_id, count(*) AS segment_count, CAST(sum(is_valid::INT) AS BIGINT) AS valid_segment_count, CAST(sum(clean_letter_count) AS BIGINT) AS letters, CAST(sum(devanagari_char_count) AS BIGINT) AS devanagari_chars, CAST(sum((devanagari_char_count > 0)::INT) AS BIGINT) AS devanagari_segments, CAST(sum(hindi_keyword_count) AS BIGINT) AS hindi_keywords, CAST(sum(len(found)) AS BIGINT) AS indic_keywords, array_to_string(list_sort(list(DISTINCT segment_type)), ',') AS segment_types, max(is_valid_non_latin_rule::INT) AS non_latin_any, md5(max({'n': clean_letter_count, 't': text}).t) AS longest_md5 FROM kw GROUP BY channel_id"),
    ("ft", "SELECT ft0.*, coalesce(array_to_string(ex[1:25], ','), '') AS keyword_examples FROM ft0 LEFT JOIN kx USING (channel_id)"),
    ("vp", "SELECT channel_id, " + ", ".join(f"bool_or(coalesce(lid_model = '{p}' AND iso639_3 IN {_in(v)}, false)) AS {p}_{n}_vote" for n, v in (("hindi", HINDI_RELATED_ISO), ("indic", INDIC_AUDIT_ISO)) for p in "ab") + " FROM lng GROUP BY channel_id"),
    ("au0", "SELECT uni.channel_id, source_language, coalesce(devanagari_chars, 0) > 0 AS contains_devanagari, coalesce(hindi_keywords, 0) AS hindi_keywords, coalesce(indic_keywords, 0) AS indic_keywords, coalesce(non_latin_any, 0) AS non_latin_any, coalesce(a_hindi_vote OR b_hindi_vote, false) AS any_hindi_vote, coalesce(a_indic_vote OR b_indic_vote, false) AS any_indic_vote, " + ", ".join(f"coalesce(a_primary_iso IN {_in(v)}, false) OR coalesce(b_primary_iso IN {_in(v)}, false) OR coalesce(a_secondary_iso IN {_in(v)}, false) OR coalesce(b_secondary_iso IN {_in(v)}, false) AS {n}_position" for n, v in (("hindi", HINDI_RELATED_ISO), ("indic", INDIC_AUDIT_ISO))) + ", coalesce(a_primary_iso = 'hin', false) OR coalesce(b_primary_iso = 'hin', false) AS hindi_primary, consensus_cluster FROM uni LEFT JOIN ft USING (channel_id) LEFT JOIN vp USING (channel_id) LEFT JOIN cs USING (channel_id)"),
    ("au1", f"SELECT *, source_language IS NOT NULL AND coalesce(source_language IN {_in(SOURCE_HINDI_CODES)}, false) <> any_hindi_vote AS source_hi_disagreement, source_language IS NOT NULL AND coalesce(source_language IN {_in(SOURCE_INDIC_CODES)}, false) <> any_indic_vote AS source_indic_disagreement FROM au0"),
    ("au", f"SELECT *, CASE WHEN hindi_primary THEN 'hindi_primary_metadata' WHEN any_hindi_vote OR hindi_position THEN 'hindi_secondary_or_topk_metadata' WHEN indic_position THEN 'indic_primary_or_secondary_metadata' WHEN contains_devanagari THEN 'devanagari_non_hindi_primary' WHEN hindi_keywords > 0 THEN 'romanized_hindi_candidate' WHEN indic_keywords > 0 THEN 'romanized_indic_candidate' WHEN source_hi_disagreement THEN 'source_hi_disagreement' WHEN source_indic_disagreement THEN 'source_indic_disagreement' WHEN consensus_cluster = '{HINDI_CLUSTER}' THEN 'indic_cluster_candidate' ELSE 'no_hindi_or_indic_signal' END AS hindi_indic_status FROM au1"),
    ("fin", "SELECT uni.channel_id, uni.source_language, mx.* EXCLUDE (channel_id), hindi_indic_status, source_hi_disagreement, source_indic_disagreement, hindi_keywords, indic_keywords, non_latin_any, CASE WHEN (a_primary_label IS NULL AND b_primary_label IS NULL) OR consensus_status = 'insufficient_text' THEN 'insufficient_text' WHEN mixed_credible THEN 'mixed_language_candidate' WHEN requires_manual THEN 'needs_review' ELSE 'classified' END AS language_status FROM uni LEFT JOIN mx USING (channel_id) LEFT JOIN au USING (channel_id)"),
]


def _with(select: str, upto: str, *more: tuple[str, str]) -> str:
    names = [n for n, _ in _CHAIN]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in [*_CHAIN[: names.index(upto) + 1], *more]) + "\n" + select


_STRATA = [
    ("high_confidence_major_language", "consensus_status IN ('exact_model_agreement', 'taxonomy_normalized_agreement') AND sh >= 0.65"), ("low_confidence", "has AND sh < 0.50"), ("credible_mixed", "mixed_credible"), ("mixed_screen_not_credible", "mixed_screen AND NOT mixed_credible"),
    ("high_risk_latin_tail_label", "a_primary_high_risk OR b_primary_high_risk"), ("hindi_indic_audit_candidate", "hindi_indic_status <> 'no_hindi_or_indic_signal'"), ("source_language_disagreement", "source_hi_disagreement OR source_indic_disagreement"),
    ("exact_disagreement", "has AND a_primary_label <> b_primary_label"), ("cluster_disagreement", "consensus_status = 'model_disagreement_needs_review'"), ("insufficient_text_or_unclassified", "language_status = 'insufficient_text'"), ("non_latin_script_control", "non_latin_any > 0"),
]
_STRATA_SQL = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _STRATA) + "], lambda x: x IS NOT NULL)"
_TAIL = f"SELECT DISTINCT channel_id, l AS high_risk_label FROM (SELECT channel_id, unnest([a_primary_label, b_primary_label]) AS l FROM fin) WHERE l IN {_in(HIGH_RISK_LABELS)}"
_SIGS = ["n_a_non_romance", "n_b_non_romance", "n_devanagari", "n_hindi_words", "n_indic_words", "n_indic_vote", "n_source_indic", "n_non_latin", "n_any"]
_RED = (
    "SELECT mx.channel_id, p.src AS model_label_source, p.l AS high_risk_label, a_vote_share, "
    + ", ".join(f"coalesce({x}_primary_iso NOT IN {_in(ROMANCE_ISO)}, false) AS n_{x}_non_romance" for x in "ab")
    + f", contains_devanagari AS n_devanagari, hindi_keywords > 0 AS n_hindi_words, indic_keywords > 0 AS n_indic_words, any_indic_vote AS n_indic_vote, coalesce(source_language IN {_in(SOURCE_INDIC_CODES)}, false) AS n_source_indic, non_latin_any > 0 AS n_non_latin, contains_devanagari OR indic_keywords > 0 OR any_indic_vote OR coalesce(source_language IN {_in(SOURCE_INDIC_CODES)}, false) OR non_latin_any > 0 AS n_any "
    + "FROM (SELECT *, unnest([" + ", ".join(f"{{'src': '{p}_{r}', 'l': {p}_{r}_label}}" for p in "ab" for r in ("primary", "secondary")) + f"]) AS p FROM mx) mx LEFT JOIN au USING (channel_id) WHERE p.l IN {_in(HIGH_RISK_LABELS)}"
)
_DESC = lambda w: {**SEGMENT_WEIGHTS, "channel_description": w}
_VARIANTS = [
    ("legacy_a", "a", LEGACY_WEIGHTS, 0, 0, 0, 0.35, True, 0, "label"), ("default_a", "a", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, True, 0, "label"), ("no_second_a", "a", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, False, 0, "label"),
    ("description_1_a", "a", _DESC(1.0), 0.2, 0.35, 0.5, 0.2, True, 0, "label"), ("no_description_a", "a", _DESC(0.0), 0.2, 0.35, 0.5, 0.2, True, 0, "label"), ("min_letters_50_a", "a", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, True, 50, "label"),
    ("top1_rollup_a", "a", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, False, 0, "iso639_3"), ("default_b", "b", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, True, 0, "label"), ("no_second_b", "b", SEGMENT_WEIGHTS, 0.2, 0.35, 0.5, 0.2, False, 0, "label"),
]
_ABL = " UNION ALL ".join(
    f"SELECT '{n}' AS variant, channel_id, {c} AS label, iso639_3, script, segment_id, segment_type, prediction_rank, score, score * ({_weight(w)}) * CASE WHEN prediction_rank = 1 THEN 1.0 ELSE {w2} END AS ws FROM l2 WHERE lid_model = '{m}' AND label IS NOT NULL AND clean_letter_count >= {k} AND ((prediction_rank = 1 AND score >= {p1}) OR ({str(s).lower()} AND prediction_rank = 2 AND score >= {p2} AND score_1 > 0 AND score / score_1 >= {r2}))"
    for n, m, w, p1, p2, r2, w2, s, k, c in _VARIANTS
)
_KIND = "CASE WHEN segment_type = 'video_description' THEN 'channel_description' ELSE segment_type END"
_RANKED = ", ".join(f"max({c}) FILTER (rk = {r}) AS {p}_{c}" for r, p, cs in ((1, "p", ("label", "iso", "script", "w")), (2, "s", ("label", "iso", "script", "w", "seg", "top1", "mean", "best", "types"))) for c in cs)
_ABLATION: list[tuple[str, str]] = [
    ("l2", f"SELECT * REPLACE ({_KIND} AS segment_type) FROM lng"), ("av", f"SELECT * FROM ({_ABL}) WHERE ws > 0"),
    ("ac", f"SELECT variant, channel_id, label, min(iso639_3) AS iso, min(script) AS script, {_sum('ws')} AS w, count(DISTINCT segment_id) AS seg, count(DISTINCT segment_id) FILTER (prediction_rank = 1) AS top1, {_mean('true')} AS mean, max(score) AS best, count(DISTINCT segment_type) AS types FROM av GROUP BY ALL"),
    ("ar", "SELECT *, row_number() OVER (PARTITION BY variant, channel_id ORDER BY w DESC, seg DESC, best DESC, label) AS rk FROM ac"),
    ("ap", f"SELECT variant, channel_id, {_RANKED}, max(w) FILTER (rk = 3) AS third FROM ar GROUP BY ALL"),
    ("aq", "SELECT *, coalesce(s_script <> p_script, false) AS crossed, coalesce(coalesce((SELECT cluster FROM clu WHERE key = p_label), (SELECT cluster FROM clu WHERE key = p_iso)) = coalesce((SELECT cluster FROM clu WHERE key = s_label), (SELECT cluster FROM clu WHERE key = s_iso)), false) AS same, coalesce(round(s_w / p_w, 9), 0) AS ratio, coalesce(round((s_w - coalesce(third, 0)) / s_w, 9), 0) AS margin FROM ap"),
    ("cell", f"SELECT variant, channel_id, p_label AS label, p_iso AS iso, s_label IS NOT NULL AND ratio >= 0.40 AND seg2 >= 2 AS screen, s_label IS NOT NULL AND ratio >= 0.50 AND seg2 >= 3 AND s_top1 >= 1 AND s_mean >= 0.45 AND (s_best >= 0.70 OR crossed) AND margin >= 0.25 AND (crossed OR s_types >= 2) AND NOT same AND s_label NOT IN {_in(HIGH_RISK_LABELS)} AS credible FROM (SELECT *, coalesce(s_seg, 0) AS seg2 FROM aq) UNION ALL SELECT 'default_consensus', channel_id, consensus_label, consensus_iso, mixed_screen, mixed_credible FROM mx"),
    ("bs", "SELECT channel_id, max(label) FILTER (variant = 'default_a') AS base, max(label) FILTER (variant = 'default_consensus') AS agreed, bool_or(credible) FILTER (variant = 'default_consensus') AS agreed_credible FROM cell GROUP BY channel_id"),
    ("gr", "SELECT v.variant, bs.*, label, iso, screen, credible, hindi_indic_status <> 'no_hindi_or_indic_signal' AND cell.channel_id IS NOT NULL AS cand FROM bs CROSS JOIN (SELECT DISTINCT variant FROM cell) v LEFT JOIN cell ON cell.variant = v.variant AND cell.channel_id = bs.channel_id LEFT JOIN au ON au.channel_id = bs.channel_id"),
]
_ABL_OUT = (
    f"SELECT variant, count(label) AS classified, count(*) FILTER (screen) AS screened, count(*) FILTER (credible) AS credible, count(*) FILTER (label IN {_in(HIGH_RISK_LABELS)}) AS high_risk, count(*) FILTER (iso = 'hin') AS hindi, count(*) FILTER (cand) AS hindi_indic, "
    + ", ".join(f"count(*) FILTER (iso = '{i}') AS n_{i}" for i in ("srd", "ast", "vec", "gug", "eng", "spa", "ita", "por"))
    + ", count(*) FILTER (base IS NOT NULL AND label IS DISTINCT FROM base) AS changed_base, count(*) FILTER (agreed IS NOT NULL AND label IS DISTINCT FROM agreed) AS changed_consensus, count(*) FILTER (coalesce(credible, false) <> coalesce(agreed_credible, false)) AS changed_credible, CASE WHEN count(base) > 0 THEN round(changed_base / count(base), 6) END AS share_changed_base, CASE WHEN count(agreed) > 0 THEN round(changed_consensus / count(agreed), 6) END AS share_changed_consensus FROM gr GROUP BY variant"
)
_BOTH = "a_primary_label IS NOT NULL AND b_primary_label IS NOT NULL"
_METRICS = {
    "all": "'all'", "consensus_status": "consensus_status", "requires_manual": "CAST(requires_manual AS VARCHAR)", "consensus_status_by_requires_manual": "consensus_status || '|' || CAST(requires_manual AS VARCHAR)", "consensus_source": "consensus_source", "consensus_script": "consensus_script",
    "cluster_coverage": f"CASE WHEN NOT ({_BOTH}) THEN 'not_both_labels' WHEN a_primary_cluster IS NULL OR b_primary_cluster IS NULL THEN 'not_both_clusters' WHEN a_primary_cluster = b_primary_cluster THEN 'clusters_agree' ELSE 'clusters_differ' END",
    **{f"{p}mixed": f"CASE WHEN {q}_credible THEN 'credible' WHEN {q}_screen THEN 'screened' ELSE 'none' END" for p, q in (("a_", "a"), ("b_", "b"), ("", "mixed"))},
    "rejection_reason": "CASE WHEN mixed_screen AND NOT mixed_credible THEN mixed_rejection_reason END", "kept_tail_label": f"CASE WHEN consensus_label IN {_in(HIGH_RISK_LABELS)} THEN consensus_label END",
    "agreement": f"CASE WHEN NOT ({_BOTH}) THEN 'not_both_labels' WHEN a_primary_label = b_primary_label THEN 'exact' WHEN agree_iso_primary THEN 'iso' WHEN agree_script_primary THEN 'script' ELSE 'none' END",
}
_DISTRIBUTIONS = " UNION ALL ".join(f"SELECT '{n}' AS metric, coalesce({e}, 'none') AS value, count(*) AS channels, count(*) FILTER (requires_manual) AS manual, round(avg(a_vote_share), 6) AS mean_share FROM mx GROUP BY ALL" for n, e in _METRICS.items())
_CATS = "[" + ", ".join(f"'{c}'" for c in sorted(CATEGORIES, key=int)) + "]"
_KNOWN = _values(list(({k: k for k in CATEGORIES} | {n.lower().replace("&", "and"): k for k, n in CATEGORIES.items()} | CATEGORY_ALIASES).items()))
_BUSINESS: list[tuple[str, str]] = [
    ("cu", "SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_custkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS a, c_custkey % 4 AS k FROM customer"),
    ("sz", "SELECT *, CASE k WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN a || 'k' WHEN 2 THEN a || ' million subscribers' ELSE 'abc' END AS follower_count, CASE WHEN a < 0 THEN NULL WHEN k = 0 THEN a WHEN k = 1 THEN a * 1000 WHEN k = 2 THEN a * 1000000 END AS subscribers FROM cu"),
    ("top", "SELECT channel_id, subscribers, 'top' AS cohort, row_number() OVER (ORDER BY subscribers DESC, channel_id) AS rk FROM sz WHERE subscribers IS NOT NULL QUALIFY rk <= 100"),
    ("band", f"SELECT channel_id, subscribers, 'band' AS cohort, row_number() OVER (ORDER BY md5(channel_id || '|{SEED}'), channel_id) AS rk FROM sz WHERE subscribers >= 1000 AND channel_id NOT IN (SELECT channel_id FROM top) QUALIFY rk <= 100"),
    ("coh", "SELECT channel_id, subscribers, CAST(rk AS INTEGER) AS selection_rank, cohort FROM top UNION ALL SELECT channel_id, subscribers, CAST(rk AS INTEGER), cohort FROM band"),
    ("lab", "SELECT CAST(o_custkey AS VARCHAR) AS channel_id, CAST(o_orderkey AS VARCHAR) AS video_id, o_orderdate, o_orderpriority, CASE o_orderpriority[1] WHEN '1' THEN ' News & Politics' WHEN '2' THEN 'music' WHEN '3' THEN 'Gaming' WHEN '4' THEN 'unknown thing' ELSE '27' END AS ai_label FROM orders"),
    ("kn", f"SELECT * FROM (VALUES {_KNOWN}) t(key, category_id)"),
    ("vt", "SELECT channel_id, category_id, count(*) AS votes FROM lab JOIN kn ON key = lower(trim(replace(ai_label, '&', 'and'))) GROUP BY ALL"),
    ("vl", "SELECT *, CAST(sum(votes) OVER (PARTITION BY channel_id) AS BIGINT) AS labelled FROM vt"),
    ("ref", "SELECT channel_id, category_id, votes, labelled, round(votes / labelled, 6) AS agreement FROM vl QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY votes DESC, CAST(category_id AS INT)) = 1 AND labelled >= 3 AND votes / labelled >= 0.5"),
    ("mo", "SELECT * FROM (VALUES " + _values(MODELS) + ") t(provider, model, k)"),
    ("jg0", f"SELECT cu.channel_id, provider, model, mo.k AS k, c_custkey, category_id AS reference, ({_CATS})[(c_custkey * mo.k + mo.k) % 15 + 1] AS other FROM cu CROSS JOIN mo LEFT JOIN ref USING (channel_id)"),
    ("jg", "SELECT channel_id, provider, model, reference, CASE WHEN c_custkey % 11 = k THEN NULL WHEN (c_custkey + k) % 2 = 0 THEN coalesce(reference, other) ELSE other END AS predicted, (c_custkey % 10 + k) / 20.0 AS confidence, c_custkey % 5 = 0 AS ambiguous FROM jg0"),
    ("pc0", "SELECT provider, model, category_id, count(*) FILTER (predicted = category_id AND reference IS NOT NULL) AS predicted_n, count(*) FILTER (reference = category_id) AS reference_n, count(*) FILTER (reference = category_id AND predicted = reference) AS true_n FROM jg CROSS JOIN (SELECT unnest(" + _CATS + ") AS category_id) GROUP BY ALL"),
    ("pc", "SELECT *, coalesce(CASE WHEN predicted_n > 0 THEN true_n / predicted_n END, 0) AS p, coalesce(CASE WHEN reference_n > 0 THEN true_n / reference_n END, 0) AS r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pc0"),
]


def _biz(select: str, *more: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in [*_BUSINESS, *more]) + "\n" + select


def _route(indic: str) -> str:
    return f"CASE WHEN consensus_status IN ('model_disagreement_needs_review', 'glotlid_fallback_openlid_low_confidence', 'openlid_high_confidence_glotlid_missing_or_error') AND NOT coalesce(a_primary_iso IN {_in(ARABIC_FAMILY_ISO)} AND b_primary_iso IN {_in(ARABIC_FAMILY_ISO)}, false) THEN 'disagreement' WHEN consensus_status = 'high_risk_tail_label_needs_review' AND consensus_label IS NULL THEN 'unresolved_tail' WHEN consensus_iso = 'eng' AND ({indic}) THEN 'shared_bias_english_indic' WHEN consensus_status IN ('exact_model_agreement', 'iso_or_script_variant_agreement', 'cluster_model_agreement', 'taxonomy_normalized_agreement', 'high_risk_tail_exact_agreement') AND CAST('0x' || substr(md5(channel_id || '|20260526'), 1, 8) AS BIGINT) % 1000000 < 200000 THEN 'agreement_audit' END"


_INDIC = "coalesce(contains_devanagari, false) OR coalesce(indic_keywords, 0) > 0 OR coalesce(lower(trim(source_language)) IN ('hi'), false)"
_ROUTED = ("rt", f"SELECT * FROM (SELECT *, {_route(_INDIC)} AS route_reason FROM (SELECT mx.*, contains_devanagari, au.indic_keywords, source_language FROM mx LEFT JOIN au USING (channel_id))) WHERE route_reason IS NOT NULL")
_SAID: list[tuple[str, str]] = [
    ("mo", "SELECT * FROM (VALUES " + _values(MODELS) + ") t(provider, model, k)"),
    ("rq", "SELECT rt.channel_id, provider, model, 'now__' || provider || '__' || model || '__' || rt.channel_id AS request_id, length(rt.channel_id) AS n, coalesce(a_primary_label, 'eng_Latn') AS a, coalesce(b_primary_label, 'none') AS b FROM rt CROSS JOIN mo"),
    ("sd", "SELECT *, CASE WHEN model = 'm1' THEN a WHEN model = 'm2' THEN b WHEN n % 2 = 0 THEN a ELSE 'und_Latn' END AS label FROM rq WHERE NOT (request_id LIKE '%7' AND model = 'm3')"),
    ("im", "SELECT request_id, provider, model, channel_id, label, nullif(split_part(label, '_', 1), 'none') AS iso639_3, nullif(split_part(label, '_', 2), '') AS script, '200' AS result_status, nullif(split_part(label, '_', 1), 'none') IS NOT NULL AND NOT (model = 'm1' AND n % 5 = 0) AS is_valid, true AS is_romanized, false AS is_mixed, CASE WHEN model = 'm2' THEN 'high' ELSE 'low' END AS confidence, model || ',x' AS mixed_languages FROM sd"),
    ("wi", "SELECT channel_id, iso639_3 AS panel_iso, count(*) AS winning_votes FROM im WHERE is_valid GROUP BY channel_id, iso639_3 QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY winning_votes DESC, panel_iso) = 1"),
    ("wl", "SELECT im.channel_id, label AS panel_label, min(script) AS sc, count(*) AS k, max(CASE confidence WHEN 'high' THEN 3 ELSE 1 END) AS r, array_to_string(list_sort(list_distinct(flatten(list(string_split(mixed_languages, ','))))), ',') AS panel_mixed_languages FROM im JOIN wi ON wi.channel_id = im.channel_id AND wi.panel_iso = im.iso639_3 WHERE is_valid GROUP BY im.channel_id, label QUALIFY row_number() OVER (PARTITION BY im.channel_id ORDER BY k DESC, r DESC, label) = 1"),
    ("wp", "SELECT channel_id, " + ", ".join(f"min(label) FILTER (is_valid AND provider = '{p}') AS {p}_label" for p in ("openai", "anthropic", "gemini")) + ", count(*) FILTER (is_valid) AS n_reached, coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (is_valid)), ','), '') AS panel_models FROM im GROUP BY channel_id"),
    ("vd", "SELECT rt.channel_id, route_reason, consensus_label, panel_iso, coalesce(winning_votes, 0) AS winning_votes, panel_label, coalesce(sc, nullif(split_part(panel_label, '_', 2), '')) AS panel_script, CASE r WHEN 3 THEN 'high' WHEN 1 THEN 'low' END AS panel_confidence, panel_label IS NOT NULL AS panel_is_romanized, false AS panel_is_mixed, panel_mixed_languages, panel_models, openai_label, anthropic_label, gemini_label, n_reached, CASE WHEN panel_iso IS NULL THEN 'no_panel_result' WHEN winning_votes >= 2 THEN 'panel_majority' ELSE 'needs_human_review' END AS panel_status, CASE WHEN route_reason = 'agreement_audit' THEN 'audit_sample' WHEN panel_iso IS NOT NULL AND winning_votes >= 2 THEN 'llm_panel' ELSE 'human_review' END AS consensus_source, route_reason = 'agreement_audit' AS audit_sample FROM rt LEFT JOIN wi USING (channel_id) LEFT JOIN wl USING (channel_id) LEFT JOIN wp USING (channel_id)"),
]
_STRIPPED = r"regexp_replace(substr(text, 1, 350), '^\s+|\s+$', '', 'g')"
_PROMPTS: list[tuple[str, str]] = [
    ("p0", f"SELECT channel_id, segment_type, substr(text, 1, 350) AS cut, CASE segment_type WHEN 'video_description' THEN 1 WHEN 'video_title' THEN 2 ELSE 3 END AS g, NOT is_valid AS late, {_STRIPPED} || CASE WHEN is_valid THEN '' ELSE ' [lid-invalid: reason=' || short_text_reason || ', letters=' || clean_letter_count || ', clean_len=' || clean_text_len || ', script=' || dominant_script || ':' || printf('%.2f', dominant_script_share) || ']' END AS entry FROM met WHERE {_STRIPPED} <> '' AND channel_id IN (SELECT channel_id FROM rt)"),
    ("p1", "SELECT *, row_number() OVER (PARTITION BY channel_id, g ORDER BY late, segment_type, cut) AS n FROM p0 QUALIFY n <= CASE g WHEN 1 THEN 4 ELSE 12 END"),
    ("p2", "SELECT channel_id, " + ", ".join(f"string_agg('- ' || entry, chr(10) ORDER BY n) FILTER (g = {g}) AS {c}" for g, c in ((1, "d"), (2, "t"), (3, "o"))) + " FROM p1 GROUP BY channel_id"),
    ("p3", f"SELECT channel_id, substr(concat_ws(chr(10), '{PROMPT_HEAD}', '{PROMPT_DESCRIPTIONS}' || chr(10) || d, '{PROMPT_TITLES}' || chr(10) || t, CASE WHEN d IS NULL AND t IS NULL THEN o END, '{PROMPT_NOTE}'), 1, 6000) AS prompt FROM p2"),
]
_COHORTS: list[tuple[str, str]] = [
    ("dz", "SELECT channel_id, CAST(sum(length(text)) AS BIGINT) AS subscribers FROM vid GROUP BY channel_id"),
    ("dt", "SELECT channel_id, subscribers, row_number() OVER (ORDER BY subscribers DESC, channel_id) AS rk, 'top' AS cohort FROM dz QUALIFY rk <= 40"),
    ("db", f"SELECT channel_id, subscribers, row_number() OVER (ORDER BY md5(channel_id || '|{SEED}'), channel_id) AS rk, 'band' AS cohort FROM dz WHERE subscribers >= 500 AND subscribers <= (SELECT min(subscribers) FROM dt) AND channel_id NOT IN (SELECT channel_id FROM dt) QUALIFY rk <= 40"),
    ("cr", "SELECT c.cohort, 'run_' || c.cohort AS run_id, c.channel_id, c.subscribers, CAST(c.rk AS INTEGER) AS selection_rank, fin.* EXCLUDE (channel_id) FROM (SELECT * FROM dt UNION ALL SELECT * FROM db) c LEFT JOIN fin ON fin.channel_id = c.channel_id"),
]
_CODES = "[" + ", ".join(f"'{c}'" for c in sorted(CATEGORIES, key=int)) + "]"
_INPUTS: list[tuple[str, str]] = [
    ("pl", "SELECT channel_id, substr(string_agg(rn || '. ' || o_orderpriority, chr(10) ORDER BY rn), 1, 7000) AS prompt, count(*) AS n_videos FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY o_orderdate DESC NULLS LAST, video_id) AS rn FROM lab QUALIFY rn <= 10) GROUP BY channel_id"),
    ("pi", "SELECT CAST(c_custkey AS VARCHAR) AS channel_id, CASE WHEN c_custkey % 3 <> 0 THEN lower(substr(c_mktsegment, 1, 3)) || '_Latn' ELSE 'unknown' END AS label, CASE WHEN c_custkey % 3 <> 0 THEN lower(substr(c_mktsegment, 1, 3)) ELSE 'unknown' END AS iso639_3, coalesce(n_videos, 0) AS n_videos, category_id, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS described, coalesce(prompt, '') AS said FROM customer LEFT JOIN pl ON pl.channel_id = CAST(c_custkey AS VARCHAR) LEFT JOIN ref ON ref.channel_id = CAST(c_custkey AS VARCHAR)"),
    ("rl", "SELECT provider, model, request_id, CAST(floor((row_number() OVER (PARTITION BY provider, model ORDER BY request_id) - 1) / 500) AS INTEGER) AS chunk_id, CASE model WHEN 'gpt-4.1' THEN '{\"custom_id\":\"' || request_id || '\",\"method\":\"POST\",\"url\":\"/v1/chat/completions\",\"body\":{\"model\":\"gpt-4.1\",\"messages\":[{\"role\":\"system\",\"content\":\"Return JSON.\"},{\"role\":\"user\",\"content\":\"' || p || '\"}],\"max_tokens\":300,\"temperature\":0.0}}' WHEN 'gpt-5-mini' THEN '{\"custom_id\":\"' || request_id || '\",\"method\":\"POST\",\"url\":\"/v1/responses\",\"body\":{\"model\":\"gpt-5-mini\",\"instructions\":\"Return JSON.\",\"input\":\"' || p || '\",\"max_output_tokens\":300}}' WHEN 'm2' THEN '{\"custom_id\":\"' || request_id || '\",\"params\":{\"model\":\"m2\",\"system\":\"Return JSON.\",\"messages\":[{\"role\":\"user\",\"content\":\"' || p || '\"}],\"max_tokens\":300,\"temperature\":0.0}}' ELSE '{\"key\":\"' || request_id || '\",\"request\":{\"system_instruction\":{\"parts\":[{\"text\":\"Return JSON.\"}]},\"contents\":[{\"role\":\"user\",\"parts\":[{\"text\":\"' || p || '\"}]}],\"generation_config\":{\"maxOutputTokens\":300,\"temperature\":0.0}}}' END AS line FROM (SELECT provider, model, 'yc_' || substr(sha256(concat_ws('||', 'default', provider, model, channel_id)), 1, 61) AS request_id, replace(prompt, chr(10), '\\n') AS p FROM pl CROSS JOIN (VALUES ('openai', 'gpt-4.1'), ('openai', 'gpt-5-mini'), ('anthropic', 'm2'), ('gemini', 'm3')) t(provider, model))"),
]
_MD5_ROW = "row_number() OVER (PARTITION BY {0} ORDER BY md5(concat_ws('|', channel_id, '" + SEED + "', {0})), channel_id)"
_METRIC_COLS = ["channel_id", "segment_type", "segment_id", "clean_text", "raw_text_len", "clean_text_len", "clean_token_count", "clean_letter_count", *[f"{s}_char_count" for s in _ALL], "dominant_script", "has_url", "has_hashtag", "has_emoji_or_symbol", "is_valid_latin_rule", "is_valid_non_latin_rule", "is_valid", "short_text_reason"]
_EVENT_HASH = _hash("event_id", "user_id", "event_type", "ts", "props")


def _qa(t: str, keys: str) -> str:
    return f"SELECT '{t}' AS source, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in, count(*) AS distinct_keys, CAST(coalesce(sum((n > 1)::INT), 0) AS BIGINT) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rows_dropped FROM (SELECT count(*) AS n FROM {t} GROUP BY {keys})"


ORACLE_SQL: dict[str, str] = {
    "qa_distributions": _with(_DISTRIBUTIONS, "mx"),
    "accepted_final": _with("SELECT unnest(['all_channels_present', 'one_row_per_channel', 'channel_is_named', 'shares_in_range', 'credible_implies_screen', 'status_is_given']) AS \"check\", unnest([n, r, m, s, c, t]) AS measured, unnest([n = u, r = 0, m = 0, s = 0, c = 0, t = 0]) AS ok FROM (SELECT count(*) AS n, (SELECT count(*) FROM uni) AS u, count(*) - count(DISTINCT channel_id) AS r, count(*) FILTER (channel_id IS NULL) AS m, count(*) FILTER (a_vote_share NOT BETWEEN 0 AND 1 OR b_vote_share NOT BETWEEN 0 AND 1) AS s, count(*) FILTER (mixed_credible AND NOT coalesce(mixed_screen, false)) AS c, count(*) FILTER (language_status IS NULL) AS t FROM fin)", "fin"),
    "signature_drill_down": _with("SELECT channel_id, segment_id, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(r) AS BIGINT) AS right_n FROM (SELECT channel_id, segment_id, 1 AS l, 0 AS r FROM val UNION ALL SELECT CASE WHEN segment_id < '02' THEN 'wrong/channel' ELSE channel_id END, segment_id, 0, 1 FROM val) GROUP BY channel_id, segment_id HAVING sum(l) <> sum(r)", "val"),
    "bucket_signatures": _with(f"SELECT {_bucket(16)} AS bucket, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS low, CAST(sum(CAST(CAST('0x' || substr(h, 17, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS high FROM (SELECT channel_id, md5(channel_id || '|' || segment_id) AS h FROM val) GROUP BY ALL", "val"),
    "flat_lines": "SELECT c_name AS value FROM customer WHERE c_custkey % 2 = 1",
    "resumed_run": _with(f"SELECT channel_id, lang, count(*) AS videos, {_bucket(16)} AS channel_hash_bucket, 'r1' AS run_id FROM vid GROUP BY ALL", "uni"),
    "published_overwrite": "WITH r AS (SELECT c_custkey, c_mktsegment, CAST(c_custkey % 8 AS INTEGER) AS channel_hash_bucket FROM customer) SELECT *, 'two' AS run_id FROM r UNION ALL SELECT *, 'one' FROM r WHERE channel_hash_bucket NOT BETWEEN 2 AND 4 UNION ALL SELECT c_custkey, 'NEW', channel_hash_bucket, 'one' FROM r WHERE channel_hash_bucket IN (2, 4) AND c_custkey % 3 = 0",
    "cohort_run_log": _with("SELECT cohort, run_id, cohort AS pool, 'succeeded' AS status, count(*) AS rows, true AS in_order FROM cr GROUP BY ALL", "fin", *_COHORTS),
    "agreement_by_cohort": _with("SELECT run_id, cohort, a_primary_iso, a_primary_script, count(*) AS channels, round(avg(agree_exact_primary::INT), 6) AS exact_rate, round(avg(agree_iso_primary::INT), 6) AS iso_rate, round(avg(agree_script_primary::INT), 6) AS script_rate, round(avg(agree_cluster_primary::INT) FILTER (a_primary_cluster IS NOT NULL AND b_primary_cluster IS NOT NULL), 6) AS within_cluster_rate, count(*) FILTER (a_primary_cluster IS NOT NULL AND b_primary_cluster IS NOT NULL) AS with_clusters, round(avg(a_vote_share), 6) AS mean_share FROM (SELECT cohort, run_id, channel_id FROM cr) JOIN mx USING (channel_id) WHERE a_primary_label IS NOT NULL AND b_primary_label IS NOT NULL GROUP BY ALL", "fin", *_COHORTS),
    "segment_unpivot": _with("SELECT channel_id, video_id, segment_type, text, segment_id FROM seg", "seg"),
    "segment_metrics": _with(f"SELECT {', '.join(_METRIC_COLS)}, round(dominant_script_share, 6) AS dominant_script_share FROM met", "met"),
    "segment_qa": _with("SELECT segment_type, is_valid, short_text_reason, dominant_script, count(*) AS segments FROM met GROUP BY ALL", "met"),
    "topk_predictions": _with("SELECT channel_id, segment_id, segment_type, lid_model, prediction_rank, label_raw, label, iso639_3, script, score FROM lng", "lng"),
    "vote_admission": _with("SELECT segment_id, lid_model, prediction_rank, label, round(weighted_score, 6) AS weighted_score FROM adm", "adm"),
    "channel_votes": _with("SELECT channel_id, lid_model, label, iso639_3, script, weighted_score, top1_weighted_score, mean_segment_score, max_segment_score, top1_mean_score, top1_max_score, segment_count, top1_segment_count, top2_segment_count, vote_count, segment_types, segment_type_count, language_rank FROM cv", "cv"),
    "channel_summary": _with("SELECT channel_id, lid_model, valid_segment_count, valid_type_count, total_letters, primary_label, primary_iso, secondary_label, secondary_segment_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("primary_score", "vote_share", "top1_vote_share", "secondary_ratio", "secondary_margin_ratio")) + " FROM sm", "sm"),
    "model_comparison_segment": _with("SELECT segment_id, x.label AS a_label, y.label AS b_label, " + ", ".join(f"x.{c} IS NOT NULL AND x.{c} = y.{c} AS agree_{n}" for c, n in (("label", "exact"), ("iso639_3", "iso"), ("script", "script"))) + " FROM (SELECT * FROM lng WHERE lid_model = 'a' AND coalesce(prediction_rank, 1) = 1) x FULL JOIN (SELECT * FROM lng WHERE lid_model = 'b' AND coalesce(prediction_rank, 1) = 1) y USING (segment_id, channel_id)", "lng"),
    "model_comparison_channel": _with("SELECT channel_id, a_primary_label, b_primary_label, a_primary_cluster, b_primary_cluster, a_primary_high_risk, b_primary_high_risk, agree_exact_primary, agree_iso_primary, agree_script_primary, agree_cluster_primary, agree_exact_secondary, agree_cluster_secondary FROM cm", "cm"),
    "consensus_labels": _with("SELECT channel_id, consensus_status, consensus_label, consensus_iso, consensus_script, consensus_cluster, consensus_rollup, requires_manual, consensus_source FROM cs", "cs"),
    "mixed_language": _with("SELECT channel_id, a_screen, b_screen, a_credible, b_credible, mixed_screen, mixed_credible, mixed_rejection_reason FROM mx", "mx"),
    "romanized_keywords": _with("SELECT segment_id, hindi_keyword_count, CAST(len(found) AS INTEGER) AS indic_keyword_count, array_to_string(list_sort(list_distinct(found)), ',') AS keyword_examples FROM kw", "kw"),
    "text_features": _with("SELECT channel_id, segment_count, valid_segment_count, letters, devanagari_chars, devanagari_segments, hindi_keywords, indic_keywords, segment_types, keyword_examples, non_latin_any, longest_md5 FROM ft", "ft"),
    "indic_audit": _with("SELECT channel_id, source_language, contains_devanagari, any_hindi_vote, any_indic_vote, hindi_position, indic_position, hindi_primary, source_hi_disagreement, source_indic_disagreement, hindi_indic_status FROM au", "au"),
    "redirect_diagnostic": _with(f"SELECT model_label_source, high_risk_label, count(*) AS channels, {', '.join(f'CAST(sum({s}::INT) AS BIGINT) AS {s}' for s in _SIGS)}, round(avg(a_vote_share), 6) AS mean_share, array_to_string(list_sort(list(channel_id) FILTER (rn <= 25)), ',') AS sample_ids FROM (SELECT *, row_number() OVER (PARTITION BY model_label_source, high_risk_label ORDER BY md5(channel_id || '|{SEED}'), channel_id) AS rn FROM rd) GROUP BY ALL", "fin", ("rd", _RED)),
    "final_channels": _with("SELECT channel_id, source_language, a_primary_label, b_primary_label, consensus_status, consensus_label, requires_manual, mixed_screen, mixed_credible, hindi_indic_status, language_status FROM fin", "fin"),
    "language_summary": _with("SELECT consensus_label, count(*) AS channels, CAST(sum(coalesce(requires_manual, false)::INT) AS BIGINT) AS manual, CAST(sum(coalesce(mixed_screen, false)::INT) AS BIGINT) AS screened, CAST(sum(coalesce(mixed_credible, false)::INT) AS BIGINT) AS credible, round(avg(a_vote_share), 6) AS mean_share, round(quantile_disc(a_vote_share, 0.5), 6) AS median_share FROM fin GROUP BY consensus_label", "fin"),
    "rollup_summary": _with("SELECT consensus_rollup, consensus_status, language_status, count(*) AS channels FROM fin GROUP BY ALL", "fin"),
    "agreement_summary": _with("SELECT a_primary_iso, a_primary_script, count(*) AS channels, round(avg(agree_exact_primary::INT), 6) AS exact_rate, round(avg(agree_iso_primary::INT), 6) AS iso_rate, round(avg(agree_script_primary::INT), 6) AS script_rate, round(avg(agree_cluster_primary::INT) FILTER (a_primary_cluster IS NOT NULL AND b_primary_cluster IS NOT NULL), 6) AS within_cluster_rate, count(*) FILTER (a_primary_cluster IS NOT NULL AND b_primary_cluster IS NOT NULL) AS with_clusters, round(avg(a_vote_share), 6) AS mean_share FROM mx WHERE a_primary_label IS NOT NULL AND b_primary_label IS NOT NULL GROUP BY ALL", "mx"),
    "source_confusion": _with("SELECT source_language, a_primary_iso, consensus_iso, count(*) AS channels FROM fin GROUP BY ALL", "fin"),
    "tail_sample": _with(f"SELECT channel_id, high_risk_label, CAST({_MD5_ROW.format('high_risk_label')} AS INTEGER) AS sample_rank FROM tl QUALIFY sample_rank <= 50", "fin", ("tl", _TAIL)),
    "validation_strata": _with(f"SELECT channel_id, q[1] AS primary_stratum, array_to_string(q, ',') AS qualifying_strata, CAST({_MD5_ROW.format('q[1]')} AS INTEGER) AS sample_rank FROM st WHERE len(q) > 0 QUALIFY sample_rank <= 100", "fin", ("s0", "SELECT *, coalesce(a_vote_share, b_vote_share, 0) AS sh, a_primary_label IS NOT NULL OR b_primary_label IS NOT NULL AS has FROM fin"), ("st", f"SELECT channel_id, {_STRATA_SQL} AS q FROM s0")),
    "unclassified": _with("SELECT channel_id, language_status, consensus_label, coalesce(segment_count, 0) AS segment_count, coalesce(valid_segment_count, 0) AS valid_segment_count, coalesce(letters, 0) AS letters FROM uni LEFT JOIN (SELECT channel_id, language_status, consensus_label FROM fin) USING (channel_id) LEFT JOIN ft USING (channel_id) WHERE coalesce(valid_segment_count, 0) = 0 OR language_status = 'insufficient_text'", "fin"),
    "ablation_summary": _with(_ABL_OUT, "fin", *_ABLATION),
    "universe_parity": _with("SELECT lid_model, count(DISTINCT segment_id) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, true AS checksum_equal FROM lng GROUP BY lid_model", "lng"),
    "acceptance_checks": "SELECT unnest(['one_row_per_channel', 'all_channels_present', 'shares_in_range', 'credible_implies_screen']) AS \"check\", true AS ok",
    "language_merge": _with("SELECT channel_id, CASE WHEN consensus_label IS NOT NULL AND NOT requires_manual AND language_status = 'classified' THEN regexp_replace(consensus_label, '_[A-Za-z]+$', '') ELSE source_language END AS language FROM fin", "fin"),
    "dedup_latest": f"SELECT event_id, user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, {_EVENT_HASH}) = 1",
    "dedup_qa": _qa("events", "user_id, event_type") + " UNION ALL " + _qa("documents", "text"),
    "top_n_recent": "SELECT o_custkey, o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS INTEGER) AS recency_rank FROM orders QUALIFY recency_rank <= 10",
    "subscriber_parse": _biz("SELECT channel_id, follower_count, subscribers FROM sz"),
    "cohort_top_n": _biz("SELECT channel_id, subscribers, selection_rank, cohort FROM coh WHERE cohort = 'top'"),
    "cohort_band_sample": _biz("SELECT channel_id, subscribers, selection_rank, cohort FROM coh WHERE cohort = 'band'"),
    "cohort_summary": _biz("SELECT cohort, min(subscribers) AS cutoff, count(*) AS channels, CAST(sum((subscribers = c)::INT) AS BIGINT) AS at_cutoff, quantile_disc(subscribers, 0.5) AS median FROM (SELECT *, min(subscribers) OVER (PARTITION BY cohort) AS c FROM coh) GROUP BY cohort"),
    "review_queue": _with("SELECT channel_id, language_status, consensus_status, hindi_indic_status FROM fin WHERE coalesce(requires_manual, false) OR language_status <> 'classified' OR coalesce(mixed_credible, false) OR hindi_indic_status <> 'no_hindi_or_indic_signal'", "fin"),
    "reference_labels": _biz("SELECT * FROM ref"),
    "stratified_sample": _biz("SELECT channel_id, category_id, c_mktsegment FROM ref JOIN cu USING (channel_id) QUALIFY row_number() OVER (PARTITION BY c_mktsegment, category_id ORDER BY sha256('20260511||' || channel_id), channel_id) <= 25"),
    "prompt_lines": _biz("SELECT channel_id, substr(string_agg(rn || '. ' || o_orderpriority, chr(10) ORDER BY rn), 1, 7000) AS prompt, count(*) AS n_videos FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY o_orderdate DESC NULLS LAST, video_id) AS rn FROM lab QUALIFY rn <= 10) GROUP BY channel_id"),
    "request_fanout": _biz("SELECT channel_id, provider, model, request_id, CAST(floor((row_number() OVER (PARTITION BY provider, model ORDER BY request_id) - 1) / 50) AS INTEGER) AS chunk_id FROM (SELECT channel_id, provider, model, 'yc_' || substr(sha256(concat_ws('||', 'default', provider, model, channel_id)), 1, 61) AS request_id FROM ref CROSS JOIN mo)"),
    "eval_overall": _biz("SELECT provider, model, count(*) AS n, count(predicted) AS n_predicted, count(reference) AS n_reference, round(avg((predicted = reference)::INT), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, CAST(sum(ambiguous::INT) AS BIGINT) AS n_ambiguous, count(*) FILTER (predicted IS NULL) AS n_parse_errors FROM jg GROUP BY ALL"),
    "per_class_f1": _biz("SELECT provider, model, category_id, predicted_n, reference_n, true_n, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM pc"),
    "macro_f1": _biz("SELECT provider, model, round(avg(f), 6) AS macro_f1 FROM pc GROUP BY ALL"),
    "pairwise_agreement": _biz("SELECT x.model AS model_a, y.model AS model_b, count(*) AS overlap, round(avg((x.predicted = y.predicted)::INT), 6) AS agreement FROM jg x JOIN jg y ON x.channel_id = y.channel_id AND x.model < y.model WHERE x.predicted IS NOT NULL AND y.predicted IS NOT NULL GROUP BY ALL"),
    "category_consensus": _biz("SELECT channel_id, predicted AS category_id, count(*) AS votes, round(avg(confidence), 6) AS mean_confidence, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM jg WHERE predicted IS NOT NULL GROUP BY channel_id, predicted QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY votes DESC, mean_confidence DESC, CAST(category_id AS INT)) = 1"),
    "panel_routing": _with("SELECT channel_id, route_reason, consensus_status, consensus_label, consensus_source AS fasttext_source FROM rt", "fin", _ROUTED),
    "panel_cap": _with("SELECT channel_id, route_reason FROM rt ORDER BY md5(channel_id), channel_id LIMIT 20", "fin", _ROUTED),
    "panel_prompts": _with(f"SELECT channel_id, coalesce(prompt, '{NO_METADATA}') AS prompt FROM (SELECT channel_id FROM rt UNION ALL SELECT 'none/0') LEFT JOIN p3 USING (channel_id)", "fin", _ROUTED, *_PROMPTS),
    "imported_results": _with("SELECT * FROM im", "fin", _ROUTED, *_SAID),
    "panel_verdict": _with("SELECT * EXCLUDE (consensus_label) FROM vd", "fin", _ROUTED, *_SAID),
    "audit_agreement": _with("SELECT lower(split_part(coalesce(consensus_label, ''), '_', 1)) = panel_iso AS agrees, count(*) AS channels FROM vd WHERE audit_sample GROUP BY ALL", "fin", _ROUTED, *_SAID),
    "verdict_coverage": "SELECT 'one_verdict_per_routed_channel' AS \"check\", true AS ok",
    "smoke_channels": _with("SELECT channel_id, count(*) AS videos FROM vid WHERE channel_id IN (SELECT channel_id FROM uni ORDER BY md5(channel_id), channel_id LIMIT 50) GROUP BY channel_id", "uni"),
    "bucket_filter": _with(f"SELECT channel_hash_bucket, count(*) AS videos, count(DISTINCT channel_id) AS channels FROM (SELECT channel_id, {_bucket(64)} AS channel_hash_bucket FROM vid) WHERE channel_hash_bucket <= 15 GROUP BY channel_hash_bucket", "uni"),
    "long_sample": _with("SELECT segment_id, lid_model, prediction_rank, label FROM lng WHERE CAST('0x' || substr(md5(concat_ws('|', segment_id, 'default', lid_model)), 1, 8) AS BIGINT) % 1000000 < 300000", "lng"),
    "fixture_rows": "SELECT kind, channel_id, subscribers FROM (VALUES ('json'), ('csv')) k(kind), (VALUES ('a', 1234::BIGINT), ('b', 1200000), ('c', NULL)) t(channel_id, subscribers)",
    "distributed_model": _with("SELECT segment_id, prediction_rank, label, iso639_3, script, score FROM lng WHERE lid_model = 'a'", "lng"),
    "audit_universe": _with(f"SELECT segment_id, segment_type FROM met WHERE is_valid AND segment_id IN (SELECT segment_id FROM lng WHERE lid_model = 'a' AND coalesce(prediction_rank, 1) = 1 AND (label IS NULL OR score < 0.5 OR label IN {_in(HIGH_RISK_LABELS)}))", "lng"),
    "native_clean": _with(rf"SELECT segment_id, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(13) || chr(10), '  '), '{_URL}', ' ', 'g'), '\s\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean_text_native FROM met WHERE is_valid", "met"),
    "checksum_parity": _with(f"SELECT {_bucket(16)} AS bucket, count(DISTINCT segment_id) AS valid_n, count(DISTINCT segment_id) AS predicted_n, true AS equal FROM val GROUP BY ALL", "val"),
    "latin_name_votes": _with(
        f"SELECT channel_id, lid_model, {_sum('w2')} AS weighted, count(*) FILTER (w2 = 0) AS silenced FROM (SELECT nv.*, CASE WHEN kind = 'channel_name' AND coalesce(s, false) THEN 0.0 ELSE w END AS w2 FROM nv LEFT JOIN nf USING (channel_id, lid_model)) GROUP BY ALL",
        "adm", ("nv", "SELECT channel_id, lid_model, segment_id, prediction_rank, kind, CASE WHEN kind <> 'channel_name' AND substr(segment_id, 1, 1) < 'c' THEN 'han' ELSE 'latin' END AS sc, score * (" + _weight(SEGMENT_WEIGHTS).replace("segment_type", "kind") + ") * CASE WHEN prediction_rank = 1 THEN 1.0 ELSE 0.2 END AS w FROM (SELECT *, CASE WHEN segment_type = 'video_title' THEN 'channel_name' ELSE segment_type END AS kind FROM adm)"),
        ("nf", "SELECT channel_id, lid_model, count(DISTINCT segment_id) FILTER (kind <> 'channel_name') >= 2 AND coalesce(avg((sc = 'han')::INT) FILTER (kind <> 'channel_name'), 0) >= 0.6 AND bool_or(kind = 'channel_name') AS s FROM nv WHERE prediction_rank = 1 GROUP BY ALL"),
    ),
    "model_qa": _with(f"SELECT lid_model, count(*) AS channels, count(primary_label) AS with_primary, count(secondary_label) AS with_secondary, count(*) FILTER (primary_label IN {_in(HIGH_RISK_LABELS)}) AS high_risk FROM sm GROUP BY lid_model", "sm"),
    "aggregation_signals": _with("SELECT channel_id, " + ", ".join(f"bool_or(coalesce(primary_iso IN {_in(v)}, false){o}) AS {n}" for v, n, o in ((HINDI_RELATED_ISO, "hindi_primary", ""), (HINDI_RELATED_ISO, "hindi_position", f" OR coalesce(secondary_iso IN {_in(HINDI_RELATED_ISO)}, false)"), (INDIC_AUDIT_ISO, "indic_position", f" OR coalesce(secondary_iso IN {_in(INDIC_AUDIT_ISO)}, false)"))) + ", " + ", ".join(f"CAST(coalesce(max((SELECT count(*) FROM cv WHERE cv.channel_id = sm.channel_id AND cv.lid_model = '{p}' AND language_rank <= 10)), 0) AS INTEGER) AS {p}_votes" for p in "ab") + " FROM sm GROUP BY channel_id", "sm"),
    "consensus_rules": "WITH " + ", ".join(f"{n} AS ({q})" for n, q in [("clu", dict(_CHAIN)["clu"]), ("one", "SELECT label, share FROM (VALUES ('eng_Latn'), ('spa_Latn'), ('glg_Latn'), ('ast_Latn'), ('arb_Arab'), ('arz_Arab'), ('cmn_Hans'), ('cmn_Latn'), ('srp_Latn'), ('srp_Cyrl'), ('hrv_Latn'), ('hin_Deva'), ('bho_Deva'), (NULL)) t(label), (VALUES (0.4::DOUBLE), (0.6), (0.7)) u(share)"), ("s1", f"SELECT label AS primary_label, share AS vote_share, split_part(label, '_', 1) AS primary_iso, coalesce((SELECT cluster FROM clu WHERE key = label), (SELECT cluster FROM clu WHERE key = split_part(label, '_', 1))) AS primary_cluster, coalesce(label IN {_in(HIGH_RISK_LABELS)}, false) AS primary_high_risk FROM one"), ("cm", "SELECT " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("primary_label", "vote_share", "primary_iso", "primary_cluster", "primary_high_risk")) + " FROM s1 a CROSS JOIN s1 b"), ("co", dict(_CHAIN)["co"]), ("cs", dict(_CHAIN)["cs"])]) + " SELECT a_primary_label, b_primary_label, a_vote_share, b_vote_share, consensus_status, consensus_label, consensus_cluster, consensus_rollup, requires_manual, consensus_source FROM cs",
    "romanized_override": _with(
        "SELECT channel_id, hit AS romanized_override, CASE WHEN hit THEN nl ELSE consensus_label END AS consensus_label, CASE WHEN hit THEN split_part(nl, '_', 1) ELSE 'eng' END AS consensus_iso, CASE WHEN hit THEN split_part(nl, '_', 2) ELSE consensus_script END AS consensus_script, CASE WHEN hit THEN (SELECT cluster FROM clu WHERE key = split_part(nl, '_', 1)) ELSE consensus_cluster END AS consensus_cluster, CASE WHEN hit THEN coalesce((SELECT cluster FROM clu WHERE key = split_part(nl, '_', 1)), split_part(nl, '_', 1)) ELSE consensus_rollup END AS consensus_rollup, consensus_label AS original_consensus_label FROM ro1",
        "fin", ("ro0", "SELECT *, " + ", ".join(f"CASE {p}_primary_label WHEN 'spa_Latn' THEN 'hin_Latn' WHEN 'ast_Latn' THEN 'urd_Arab' END AS {p}x" for p in "ab") + " FROM fin"),
        ("ro1", "SELECT *, length(channel_id) % 3 >= 1 AND (bx IS NOT NULL OR (ax IS NOT NULL AND coalesce(a_vote_share, 0) >= 0.5)) AS hit, coalesce(bx, ax) AS nl FROM ro0"),
    ),
    "strata_counts": _with(f"SELECT primary_stratum, count(*) AS channels, count(*) < 20 AS below_minimum FROM (SELECT channel_id, q[1] AS primary_stratum, {_MD5_ROW.format('q[1]')} AS k FROM st WHERE len(q) > 0 QUALIFY k <= 100) GROUP BY ALL", "fin", ("s0", "SELECT *, coalesce(a_vote_share, b_vote_share, 0) AS sh, a_primary_label IS NOT NULL OR b_primary_label IS NOT NULL AS has FROM fin"), ("st", f"SELECT channel_id, {_STRATA_SQL} AS q FROM s0")),
    "stable_keys": f"SELECT doc_id, CASE WHEN trim(video_id) <> '' THEN trim(video_id) ELSE 'rowhash:' || {_hash('doc_id', 'text', 'video_id')} END AS key FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 5 < 4 THEN ' ' || CAST(doc_id AS VARCHAR) END AS video_id FROM documents)",
    "usable_channels": "SELECT CAST(o_custkey AS VARCHAR) AS channel_id, CAST(floor(o_totalprice) AS BIGINT) AS subscribers FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, floor(o_totalprice) DESC) = 1",
    "cohort_cutoff": _biz("SELECT (SELECT min(subscribers) FROM top) AS cutoff, count(*) AS at_cutoff, count(*) FILTER (channel_id IN (SELECT channel_id FROM top)) AS in_top, at_cutoff - in_top AS outside FROM sz WHERE subscribers = (SELECT min(subscribers) FROM top)"),
    "selected_videos": _biz("SELECT o_custkey, o_orderkey, cohort FROM orders JOIN coh ON channel_id = CAST(o_custkey AS VARCHAR)"),
    "cohort_results": _with("SELECT cohort, run_id, channel_id, selection_rank, consensus_status, consensus_label, language_status FROM cr", "fin", *_COHORTS),
    "cohort_status_summary": _with("SELECT cohort, run_id, language_status, consensus_status, count(*) AS channels, round(avg(subscribers), 6) AS mean_size, quantile_disc(subscribers, 0.5) AS median_size, count(*) FILTER (coalesce(requires_manual, false)) AS manual FROM cr GROUP BY ALL", "fin", *_COHORTS),
    "cohort_language_review": _with("SELECT cohort, run_id, consensus_label, consensus_iso, consensus_rollup, requires_manual, count(*) AS channels, round(avg(a_vote_share), 6) AS a_mean_share, round(avg(b_vote_share), 6) AS b_mean_share, count(*) FILTER (coalesce(mixed_credible, false)) AS credible, count(*) FILTER (hindi_indic_status <> 'no_hindi_or_indic_signal') AS hindi_indic FROM cr GROUP BY ALL", "fin", *_COHORTS),
    "request_fanout_plain": _biz("SELECT channel_id, provider, model, request_id, CAST(floor((row_number() OVER (PARTITION BY provider, model ORDER BY request_id) - 1) / 50) AS INTEGER) AS chunk_id FROM (SELECT channel_id, provider, model, 'default__' || provider || '__' || model || '__' || channel_id AS request_id FROM ref CROSS JOIN mo)"),
    "prompt_inputs": _biz("SELECT channel_id, label, iso639_3, n_videos, category_id, substr('Classify the following YouTube channel into exactly one allowed category. Return strict JSON only.' || chr(10) || chr(10) || 'Channel name: ' || c_name || chr(10) || 'Detected language: ' || label || ' (' || iso639_3 || ')' || chr(10) || 'Channel description: ' || described || chr(10) || chr(10) || 'Recent videos:' || chr(10) || said || chr(10), 1, 300) AS prompt FROM pi", *_INPUTS[:2]),
    "run_modes": _biz(
        "SELECT 'labeled_validation' AS mode, channel_id FROM (SELECT channel_id, h FROM hp WHERE category_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY iso639_3, category_id ORDER BY h, channel_id) <= 7 ORDER BY h, channel_id LIMIT 40) UNION ALL SELECT 'unlabeled_pilot', channel_id FROM (SELECT channel_id, h FROM hp WHERE category_id IS NULL QUALIFY row_number() OVER (PARTITION BY iso639_3 ORDER BY h, channel_id) <= 7 ORDER BY h, channel_id LIMIT 40) UNION ALL SELECT 'full_unlabeled', channel_id FROM hp WHERE category_id IS NULL UNION ALL SELECT 'all', channel_id FROM (SELECT channel_id FROM hp ORDER BY h, channel_id LIMIT 40)",
        *_INPUTS[:2], ("hp", "SELECT *, sha256('20260511||' || channel_id) AS h FROM pi"),
    ),
    "batch_lines": _biz("SELECT request_id, md5(line) AS line_md5 FROM rl", *_INPUTS),
    "request_files": _biz("SELECT provider, model, chunk_id, count(*) AS n_requests, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, 'submitted' AS status, count(*) AS n_lines, CAST(1 AS BIGINT) AS n_files FROM rl GROUP BY ALL", *_INPUTS),
    "evaluation": _biz(
        "SELECT provider, model, n, n_predicted, n_reference, accuracy, mean_confidence, n_ambiguous, n_parse_errors, macro_precision, macro_recall, macro_f1, 'overall' AS level, NULL AS language FROM (SELECT provider, model, count(*) AS n, count(predicted) AS n_predicted, count(reference) AS n_reference, round(avg((predicted = reference)::INT), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, CAST(sum(ambiguous::INT) AS BIGINT) AS n_ambiguous, count(*) FILTER (predicted IS NULL) AS n_parse_errors FROM jg GROUP BY ALL) LEFT JOIN (SELECT provider, model, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM pc GROUP BY ALL) USING (provider, model) UNION ALL SELECT provider, model, count(*), count(*), count(*), round(avg((predicted = reference)::INT), 6), round(avg(confidence), 6), NULL, NULL, NULL, NULL, NULL, 'language', c_mktsegment FROM jg JOIN cu USING (channel_id) WHERE predicted IS NOT NULL AND reference IS NOT NULL GROUP BY provider, model, c_mktsegment"
    ),
    "results_to_requests": f"SELECT o_orderkey, channel_id, reference, category_id, CASE WHEN reference IS NOT NULL AND category_id IS NOT NULL THEN reference = category_id END AS correct, iso639_3 FROM (SELECT o_orderkey, o_custkey, o_orderkey % 11 <> 0 AS mine, CASE WHEN o_orderkey % 4 > 0 THEN ({_CODES})[(o_custkey + o_orderkey % 2) % 15 + 1] END AS category_id FROM orders) LEFT JOIN (SELECT c_custkey, c_name AS channel_id, CASE WHEN c_custkey % 3 > 0 THEN ({_CODES})[c_custkey % 15 + 1] END AS reference, lower(c_mktsegment) AS iso639_3 FROM customer WHERE c_custkey % 7 <> 0) ON mine AND c_custkey = o_custkey",
    "scoped_overwrite": "WITH t AS (SELECT c_custkey, CAST(c_custkey % 8 AS INTEGER) AS channel_hash_bucket, r AS run_id FROM customer CROSS JOIN (VALUES ('one'), ('two')) v(r) WHERE r = 'two' OR c_custkey % 8 < 2 OR (c_custkey % 8 IN (2, 4, 5) AND c_custkey % 3 = 0)) SELECT 'all' AS scope, run_id, channel_hash_bucket, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'current run', run_id, channel_hash_bucket, count(*) FROM t WHERE run_id = 'one' AND channel_hash_bucket >= 1 GROUP BY ALL",
    "run_overwrite": "SELECT * FROM (VALUES ('full', 'r1', 9::BIGINT, 0::BIGINT, 9::BIGINT), ('part', 'r1', 25, 0, 0), ('all', 'r1', 34, 0, 9), ('all', 'r2', 5, 5, 0)) t(scope, run_id, n, named, more)",
    "found_tables": "SELECT doc_id AS key, CAST(length(text) AS INTEGER) AS chars, 'r' AS run_id FROM documents",
    "result_parse": "SELECT 'r' || event_id AS request_id, CASE event_id % 5 WHEN 0 THEN '200' WHEN 2 THEN 'succeeded' WHEN 4 THEN 'unknown' ELSE 'succeeded' END AS status, CASE WHEN event_id % 5 = 4 THEN '{\"message\":\"x\"}' END AS error, CASE WHEN event_id % 5 = 2 THEN 7::BIGINT END AS input_tokens, CASE WHEN event_id % 5 < 4 THEN CASE event_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '27' WHEN 2 THEN '20' END END AS category_id, CASE WHEN event_id % 5 < 4 THEN CASE event_id % 4 WHEN 0 THEN 'Music' WHEN 1 THEN 'Education' WHEN 2 THEN 'Gaming' END END AS category_name, CASE WHEN event_id % 5 < 4 AND event_id % 4 < 3 THEN least(1.0, event_id % 3)::DOUBLE END AS confidence, CASE WHEN event_id % 5 < 4 AND event_id % 4 < 3 THEN true END AS ambiguous, CASE WHEN event_id % 5 = 4 THEN 'invalid_or_missing_json' WHEN event_id % 4 = 3 THEN 'invalid_category_id:nonsense' END AS parse_error FROM events",
}
