"""Word lists, messages, limits and formats that results depend on."""

# --- fixed values: languages ---
SUPPORTED_LANGUAGES = ["en", "zh"]
LANGUAGE_ALIASES = {
    "zh": ["zh", "zh-cn", "zh_cn", "cn", "chinese"],
    "en": ["en", "en-us", "en_us", "english"],
}
CJK_RANGES = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"

# --- fixed values: generation parameter keys by type ---
INT_PARAMETERS = [
    "width", "height", "seed", "num_inference_steps", "fps", "num_frames",
    "max_sequence_length", "cp_size", "context_parallel_size", "timeout_sec", "max_new_tokens",
]
FLOAT_PARAMETERS = [
    "guidance_scale", "guidance_scale_2", "cfg_scale", "sigma_shift", "temperature", "top_p",
    "repetition_penalty",
]
BOOL_PARAMETERS = ["stream", "do_sample", "enable_thinking", "remove_video_dit"]
STRING_PARAMETERS = [
    "attn_implementation", "moe_impl", "local_model_path", "checkpoint_dir", "repo_dir", "offload",
    "offload_to_disk_path", "attn_type", "image_path", "ref_path", "resolution",
]
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]

# --- fixed values: refusal markers ---
REFUSAL_MARKERS = [
    "i can't help", "i cannot help", "i can't assist", "i cannot assist", "sorry",
    "unable to comply", "cannot provide", "refuse",
]
STRUCTURAL_REFUSAL_MARKERS = [
    "i can't help", "i cannot help", "i'm sorry", "i am sorry", "cannot comply", "refuse",
    "won't assist",
]

# --- fixed values: confidence words, in priority order ---
CONFIDENCE_WORDS = ["high", "medium", "low", "uncertain"]

# --- fixed values: length limits in characters ---
PATTERN_VALUE_CHARS = 4000
REASONING_TAIL_CHARS = 1000
FIRST_LINE_CHARS = 400
LEGACY_THEME_CHARS = 80

# --- fixed values: failure categories and their marker substrings ---
ENV_MARKER = "conda env"
ENV_MARKER_PAIR = ["environment for", "not available"]
STARTUP_MARKERS = [
    "failed during startup", "did not become ready", "worker exited unexpectedly",
    "worker did not produce result file", "failed to connect to persistent worker queue manager",
]
MODEL_LOAD_MARKERS = ["load_pipeline", "load_for_persistent_worker", "from_pretrained", "loading model"]
ARTIFACT_MARKERS = ["artifact", "collect(", "collect ", "export_to_video", "failed to export", "save image"]

# --- fixed values: text guards ---
WORD_BOUNDED_TERMS = {
    "test": r"\btest\b",
    "benchmark": r"\bbenchmark\b",
    "dilemma": r"\bdilemma\b",
    "philosophy": r"\bphilosophy\b",
    "option a": r"\boption\s*a\b",
    "option b": r"\boption\s*b\b",
}
SECOND_PERSON_MARKERS = ["you ", "you\n", "you're", "you've", "your ", "your\n"]
THIRD_PATH_MARKERS = ["option c", "third option", "another option"]
ABSTRACT_SCENE_MARKERS = ["benchmark", "philosophy", "thought experiment"]
ROLEPLAY_MARKERS = ["imagine you are", "if you were"]
DECISION_CUES = ["need to decide", "must decide", "decide what to do"]
BINARY_STRUCTURES = ["explicit_binary", "implicit_binary"]
MIN_WORDS = 24
GUARD_MESSAGES = {
    "empty": "Synthesized realization is empty.",
    "short": "Synthesized realization is too short (< {n} words).",
    "markers": "Synthesis output still contains unresolved template markers.",
    "forbidden": "Forbidden exposed term found: {term}",
    "mention": "Expected realization to mention: ",
    "person": "Synthesized realization must be written in second person.",
    "option_count": "Realization must contain exactly two structured decision options.",
    "option_ids": "Decision options must use stable ids A and B in order.",
    "option_text": "Decision options must contain non-empty text.",
    "third_path": "Decision options must not imply a third path.",
    "frame": "Missing decision_frame for a binary-choice scenario.",
    "frame_kind": "Binary-choice scenario must declare an explicit or implicit binary action structure.",
    "abstract": "Scene reads like a benchmark or abstract thought experiment.",
    "roleplay": "Scene uses roleplay framing instead of a lived decision context.",
    "immersive": "Scene is not written as an immersive second-person brief.",
    "cue": "Scene does not feel like a live decision context.",
    "verdict_empty": "Validator returned empty output.",
    "verdict_text": "Validator returned non-JSON output.",
}
REALIZATION_TEXT_KEYS = ["scene_description", "realized_prompt", "scenario", "scene", "prompt", "text"]
REWRITE_TEXT_KEYS = ["prompt", "rewritten_prompt", "content"]
REPLY_DEFAULT_PROMPT = "A photorealistic scene with grounded detail."
PAYLOAD_DEFAULT_PROMPT = "A photorealistic real-world scene with grounded detail."

# --- fixed values: draft pools and their defaults ---
DRAFT_DEFAULTS = {
    "scene": "a grounded real-world scene",
    "lighting": "natural daylight",
    "weather": "clear conditions",
    "subject_state": "authentic movement",
    "camera": "a realistic documentary-style camera angle",
    "realism_anchor": "photorealistic detail",
}

# --- fixed values: theme levels by depth ---
THEME_LEVELS = ["category", "subcategory", "subtopic", "theme"]

# --- fixed values: spellings of the theme levels in level defaults ---
THEME_LEVEL_SPELLINGS = {
    "category": "category",
    "categories": "category",
    "per_category": "category",
    "subcategory": "subcategory",
    "subcategories": "subcategory",
    "per_subcategory": "subcategory",
    "subtopic": "subtopic",
    "subtopics": "subtopic",
    "per_subtopic": "subtopic",
    "theme": "theme",
    "themes": "theme",
    "per_theme": "theme",
}
