"""Prompt templates and single-pass placeholder rendering.

Rendering splits a template on its named placeholders on the driver and builds one
``concat(lit, col, lit, ...)`` expression: every placeholder is filled exactly once, other braces
stay literal, and text inside an answer that happens to look like ``{question}`` is never
re-expanded (a chain of ``replace`` calls would do that).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# The prompt texts sent to the models (kind, dimension/variant) -> (system, user).
# ---------------------------------------------------------------------------------------------
JUDGE_SYSTEM = "You are an AI judge. Follow the user instruction exactly and answer with only A or B."
FACTUAL_SYSTEM = "You are an AI judge. Follow the user instruction exactly and answer with only Yes or No."
EXPLAIN_SYSTEM = "You are an AI judge. Explain the model preference briefly and concretely."
JSON_SYSTEM = "Answer only with valid JSON."
EDITOR_SYSTEM = "You are a careful Italian medical communication editor. Follow the user instruction exactly."

JUDGE_USER = """Given a patient question and two responses, which response has higher {what}?
Answer with only A or B.

Patient question:
{{question}}

A. {{sentence_a}}

B. {{sentence_b}}"""

FACTUAL_USER = {
    "preservation": """Given a patient question, an original medical answer, and a rewritten answer, does the rewritten answer preserve the clinically important information from the original answer?
Answer with only Yes or No.

Patient question:
{question}

Original medical answer:
{original_answer}

Rewritten answer:
{generated_answer}""",
    "unsupported_addition": """Given a patient question, an original medical answer, and a rewritten answer, does the rewritten answer introduce new medical facts, conditions, advice, warnings, diagnoses, treatment instructions, or follow-up recommendations that were not present in the original answer?
Answer with only Yes or No.

Patient question:
{question}

Original medical answer:
{original_answer}

Rewritten answer:
{generated_answer}""",
}

EXPLAIN_USER = """The judge preferred the original response over the empathy-augmented response for {DIM}.
Explain why the generated empathy-augmented response may have been judged {judged}.
Focus on concrete differences such as {focus}.
Do not invent facts. Use only the texts below.
Write 1-3 concise sentences.

Patient question:
{{question}}

Original response:
{{original_answer}}

Empathy-augmented response:
{{generated_answer}}

Judge raw answer:
{{raw_judge_response}}

Explanation:"""
EXPLAIN_PARTS = {
    "quality": ("QUALITY", "lower in quality",
                "medical accuracy, completeness, clarity, relevance, unnecessary additions, or loss of important information"),
    "empathy": ("EMPATHY", "less empathetic",
                "warmth, acknowledgement, reassurance, tone, or whether the added wording feels formulaic or inappropriate"),
}

GENERATION_BASIC = """Rewrite the Italian medical answer to make it more empathetic and supportive.

Rules:
- Keep the same medical meaning.
- Do not add new medical facts.
- Do not remove important medical information.
- Do not give a diagnosis beyond the original answer.
- Do not mention that you are an AI.
- Keep the answer in Italian.
{length_rule}- Write only the rewritten answer, without explanations or labels.

Patient question:
{{question}}

Original medical answer:
{{original_answer}}

Empathy-augmented answer:"""
LENGTH_RULE = "- Keep the rewritten answer similar in length to the original answer.\n"

_EDIT_PRINCIPLES = """Key editing principles:

1. Preserve factual and clinical accuracy.
- Do not introduce or infer medical facts or conditions not explicitly stated in the original response.
- Do not make any clinical assumptions or diagnoses that are not present in the original response.

2. Respect the original response's intent.
- Do not add follow-up recommendations or next-step suggestions unless they already appear in the original response.
- Do not add new advice, warnings, or treatment instructions.

3. Maintain emotional balance.
- Do not add false reassurance or overconfidence.
- Do not introduce unnecessary doubt, fear, or alarming language.
- Empathy should be expressed through tone, acknowledgment, and understanding, not through added medical content.

"""
GENERATION_REFINED = ("Rewrite the Italian medical answer to make it more empathetic and supportive.\n\n" + _EDIT_PRINCIPLES +
                      """4. Preserve structure and style.
- Keep the response roughly the same length as the original.
- Maintain the professional medical tone and sentence structure where possible.
- Revise only what's necessary to make the tone warmer, more understanding, or more supportive.

5. Output requirements.
- Keep the answer in Italian.
- Write only the rewritten answer, without explanations or labels.

Patient question:
{question}

Original medical answer:
{original_answer}

Rewritten answer:""")
GENERATION_CONCISE = ("Rewrite the Italian medical answer to make it warmer, more empathetic, and more concise than the original.\n\n"
                      + _EDIT_PRINCIPLES + """4. Make the response concise.
- Make the rewritten answer shorter than the original when possible.
- Remove redundancy, repetition, and unnecessary wording.
- Preserve all clinically important information.
- Maintain a professional medical tone.

5. Output requirements.
- Keep the answer in Italian.
- Write only the rewritten answer, without explanations or labels.

Patient question:
{question}

Original medical answer:
{original_answer}

Concise empathy-edited answer:""")
DEFAULT_GENERATION_VARIANT = "v1"

# Calibration runs (two-source rated set: variants x dimensions; rephrasing set: one prompt).
CAL_VARIANTS = ["paper_minimal", "paper_guided_editprompt"]
CAL_FOCUS = {"quality": "quality of information", "empathy": "empathy or bedside manner"}
CAL_GUIDED_USER = """Read the entire patient question and both anonymized responses.
Which response provides higher {focus}?
Do not choose based on response length alone or assumed source. Focus on the {focus} provided.
Answer with only A or B.

Patient question:
{{question}}

A. {{sentence_a}}

B. {{sentence_b}}"""
CAL_VARIANT_NOTE = {
    "paper_minimal": "paper_minimal.",
    "paper_guided_editprompt": "paper_guided_editprompt. The judge was asked to choose the response with higher "
                               "{focus}, while not choosing based on response length alone or assumed source.",
}
CAL_MISMATCH = """You are analyzing a mismatch between an AI judge and the gold label for a JAMA response {dim} comparison.

Gold label construction:
The gold label is based on the average of the three human evaluator {dim} scores. The response with the higher average {dim} score is treated as the preferred response.

Judge prompt variant:
{note}

Patient question:
{{question}}

Physician response:
{{physician_answer}}

ChatGPT response:
{{chatgpt_answer}}

Average physician {dim} score:
{{physician_avg}}

Average ChatGPT {dim} score:
{{chatgpt_avg}}

Prompt order shown to the judge:
{{response_order}}

Judge chose:
{{pred_choice}}

Correct choice according to average human {dim} score:
{{gold_choice}}

Briefly explain why the judge may have chosen the wrong response for response {dim}.

Answer ONLY with valid JSON:
{{{{"mismatch_explanation": "brief explanation in English"}}}}"""

REPHRASE_SYSTEM = ("You are an AI judge for empathy evaluation. You must choose which of two Italian sentences is "
                   "more empathetic. Answer with only A or B.")
REPHRASE_USER = """Given these two Italian sentences, which one is more empathetic?
Answer with only A or B.

A. {sentence_a}

B. {sentence_b}"""
REPHRASE_MISMATCH = """You are analyzing a mismatch between an AI judge and the gold label for an empathy pairwise comparison.

The dataset row was selected because Incremento_empatia is 4 or 5, so the gold label says that ANSWER WITH EMPATHY is more empathetic than ANSWER.

User question:
{question}

ANSWER:
{normal_answer}

ANSWER WITH EMPATHY:
{empathy_answer}

Prompt order shown to the judge:
{response_order}

Judge chose:
{pred_choice}

Correct choice according to the gold label:
{gold_choice}

Briefly explain why the judge may have chosen the wrong sentence, focusing on empathy and emotional support.

Answer ONLY with valid JSON:
{{"mismatch_explanation": "brief explanation in English"}}"""
# ---------------------------------------------------------------------------------------------


def template_rows() -> list[tuple[str, str, str, str]]:
    """(kind, key, system, user_template) for every built-in template; ``key`` is the judge
    dimension, factual check, explanation dimension or generation variant."""
    rows = [("judge", d, JUDGE_SYSTEM, JUDGE_USER.format(what=d)) for d in ("empathy", "quality")]
    rows += [("factual", k, FACTUAL_SYSTEM, v) for k, v in FACTUAL_USER.items()]
    rows += [("explain", d, EXPLAIN_SYSTEM, EXPLAIN_USER.format(DIM=a, judged=b, focus=c))
             for d, (a, b, c) in EXPLAIN_PARTS.items()]
    rows += [("generation", "v1", EDITOR_SYSTEM, GENERATION_BASIC.format(length_rule="")),
             ("generation", "v2_length_matched", EDITOR_SYSTEM, GENERATION_BASIC.format(length_rule=LENGTH_RULE)),
             ("generation", "v3_refined_clinical_editing", EDITOR_SYSTEM, GENERATION_REFINED),
             ("generation", "v4_concise_clinical_editing", EDITOR_SYSTEM, GENERATION_CONCISE)]
    for v in CAL_VARIANTS:
        for d, focus in CAL_FOCUS.items():
            user = JUDGE_USER.format(what=d) if v == "paper_minimal" else CAL_GUIDED_USER.format(focus=focus)
            rows.append(("calibration", f"{v}:{d}", JUDGE_SYSTEM, user))
            rows.append(("calibration_explain", f"{v}:{d}", JSON_SYSTEM,
                         CAL_MISMATCH.format(dim=d, note=CAL_VARIANT_NOTE[v].format(focus=focus))))
    rows.append(("calibration", "rephrase", REPHRASE_SYSTEM, REPHRASE_USER))
    rows.append(("calibration_explain", "rephrase", JSON_SYSTEM, REPHRASE_MISMATCH))
    return rows


def template(kind: str, key: str) -> tuple[str, str]:
    """(system, user) for a kind and key; unknown keys fall back to the kind's default (judge and
    explanation: empathy; factual: preservation; generation: v1)."""
    table = {(k, d): (s, u) for k, d, s, u in template_rows()}
    defaults = {"judge": "empathy", "explain": "empathy", "factual": "preservation",
                "generation": DEFAULT_GENERATION_VARIANT, "calibration": "paper_minimal:empathy",
                "calibration_explain": "paper_minimal:empathy"}
    return table.get((kind, key)) or table[(kind, defaults[kind])]


_PH = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def split_template(tpl: str, names) -> list[tuple[str, str]]:
    """Template -> [("lit", text) | ("col", name)], splitting only on the given placeholder names."""
    out, pos = [], 0
    for m in _PH.finditer(tpl):
        if m.group(1) not in names:
            continue
        if m.start() > pos:
            out.append(("lit", tpl[pos:m.start()]))
        out.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(tpl):
        out.append(("lit", tpl[pos:]))
    return out


def render(tpl: str, **cols) -> Column:
    """Fill ``{name}`` placeholders with the given Columns in one pass; NULL fills as ''."""
    parts = []
    for kind, v in split_template(tpl, set(cols)):
        parts.append(F.lit(v) if kind == "lit" else F.coalesce(cols[v].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
