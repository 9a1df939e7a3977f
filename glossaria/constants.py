"""Label sets, maps, word lists and patterns that results depend on."""

HIGH_RISK_LABELS = ["srd_Latn", "ast_Latn", "vec_Latn", "gug_Latn", "pap_Latn", "fur_Latn", "scn_Latn", "lim_Latn", "mlt_Latn", "som_Latn", "swh_Latn", "yor_Latn", "hau_Latn", "kin_Latn", "sun_Latn", "bjn_Latn", "min_Latn", "ekk_Latn", "als_Latn"]
HINDI_RELATED_ISO = ["hin", "bho", "awa", "mai", "mag"]
INDIC_AUDIT_ISO = ["hin", "bho", "awa", "mai", "mag", "npi", "mar", "urd", "pan", "guj"]
SOURCE_HINDI_CODES = ["hi", "hi-in", "hin"]
SOURCE_INDIC_CODES = ["hi", "hi-in", "hin", "ne", "ne-np", "npi", "bho", "ur", "ur-pk", "pa", "gu", "mr"]
PANEL_SOURCE_INDIC_CODES = [*SOURCE_INDIC_CODES, "bn", "ta", "te", "kn", "ml", "or", "si"]
SOUTH_ASIAN_ISO = ["hin", "urd", "pan", "ben", "tel", "tam", "mal", "guj", "mar", "ory", "kan", "sin", "npi", "bho", "awa", "mai", "mag", "asm", "snd", "kas", "doi", "san"]
ARABIC_FAMILY_ISO = ["ara", "arb", "ary", "arz", "apc", "ars", "ajp", "aeb", "acm", "acq", "aec", "afb", "ayl", "ayn"]
ROMANCE_ISO = ["spa", "por", "ita", "fra", "ron", "cat", "glg", "ast", "srd", "vec", "scn", "fur", "lmo", "oci", "gug", "pap", "lim", "mlt", "cos", "arg", "wln", "frp", "lad", "roh", "lij", "nap"]
HINDI_CLUSTER = "hindi_related_north_indic_review_cluster"
CLUSTERS = {
    "hbs_BCMS": ["bos", "hrv", "srp", "cnr"],
    "ind_zsm_malay_indonesian_cluster": ["ind", "zsm"],
    "cmn_Chinese": ["cmn_Hans", "cmn_Hant"],
    HINDI_CLUSTER: HINDI_RELATED_ISO,
    "italian_romance_review_cluster": ["ita", "srd", "vec", "scn", "fur", "lmo"],
    "iberian_romance_review_cluster": ["spa", "ast", "glg", "cat"],
}
ROMANIZED_HINDI_KEYWORDS = ["hindi", "bhajan", "bollywood", "krishna", "kanha", "radha", "mahadev", "shiv", "ramayan", "katha", "pravachan", "samachar", "khabar", "modi", "yogi", "sarkar", "chunav", "desi", "upsc", "ssc", "gk", "current affairs in hindi"]
ROMANIZED_INDIC_KEYWORDS = [*ROMANIZED_HINDI_KEYWORDS, "nepali", "lok dohori", "dohori", "maya", "timro", "mero", "timi", "bhojpuri", "punjabi", "urdu", "ghazal", "qawwali", "kirtan"]
NOISE_LABEL = "^(zxx|und|noise|null|none|unknown)"
SCRIPTS = {"latin": r"\p{IsLatin}", "devanagari": r"\p{IsDevanagari}", "arabic": r"\p{IsArabic}", "cyrillic": r"\p{IsCyrillic}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "thai": r"\p{IsThai}"}
SEGMENT_WEIGHTS = {"channel_description": 1.0, "video_title": 2.0, "video_description": 1.0, "video_tags": 0.5, "channel_name": 0.25}
LEGACY_WEIGHTS = {"channel_name": 0.5, "channel_description": 3.0, "video_title": 2.0, "video_description": 1.0, "video_tags": 0.75}
CATEGORIES = {"1": "Film & Animation", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports", "19": "Travel & Events", "20": "Gaming", "22": "People & Blogs", "23": "Comedy", "24": "Entertainment", "25": "News & Politics", "26": "Howto & Style", "27": "Education", "28": "Science & Technology", "29": "Nonprofits & Activism"}
CATEGORY_ALIASES = {"film": "1", "film and animation": "1", "autos": "2", "auto": "2", "vehicles": "2", "music": "10", "animals": "15", "pets": "15", "sports": "17", "travel": "19", "events": "19", "gaming": "20", "games": "20", "people": "22", "blogs": "22", "vlog": "22", "vlogs": "22", "comedy": "23", "entertainment": "24", "news": "25", "politics": "25", "news and politics": "25", "howto": "26", "how-to": "26", "style": "26", "howto and style": "26", "education": "27", "educational": "27", "science": "28", "technology": "28", "science and technology": "28", "nonprofits": "29", "activism": "29", "nonprofits and activism": "29"}
DISAGREEMENT_STATUSES = ["model_disagreement_needs_review", "glotlid_fallback_openlid_low_confidence", "openlid_high_confidence_glotlid_missing_or_error"]
AGREEMENT_STATUSES = ["exact_model_agreement", "iso_or_script_variant_agreement", "cluster_model_agreement", "taxonomy_normalized_agreement", "high_risk_tail_exact_agreement"]
ROUTES = ["disagreement", "unresolved_tail", "shared_bias_english_indic", "agreement_audit"]
