"""Prompts as Column expressions, in three protocols, with worked examples and rule texts by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One rule text a system, put before the context where it is asked for.
RULES = {
    "hawaiian": "Hawaiian kinship merges all relatives of the same generation and sex: mother's sisters and father's sisters are both classified as 'mothers', mother's brothers and father's brothers are both classified as 'fathers', and all cousins are classified as siblings.",
    "iroquois": "Iroquois kinship distinguishes parallel relatives (same-sex parents' siblings) from cross relatives. Father's brother is classified as 'father' and mother's sister as 'mother' (parallel); father's sister and mother's brother receive distinct terms (cross). Parallel cousins are classified as siblings; cross cousins are distinguished.",
    "dravidian": "Dravidian kinship uses the Iroquois parallel/cross distinction, but cross-cousins (father's sister's children and mother's brother's children) are classified as potential marriage partners rather than as kin.",
    "crow": "Crow kinship applies matrilineal skewing: members of the father's matrilineage are classified upward generationally. Father's sister's children are classified as 'fathers' or 'female fathers' regardless of their actual generation.",
    "omaha": "Omaha kinship applies patrilineal skewing (the mirror of Crow): members of the mother's patrilineage are classified upward generationally. Mother's brother's children are classified as 'mothers' or 'male mothers' regardless of their actual generation.",
}

#: Prompt wordings; {context}, {question}, {rule} and {examples} are filled in.
DIRECT = """Answer the following question based on the given context.
Be concise and provide only the answer without explanation.

{rule}Context: {context}

Question: {question}

Answer:"""
STYLES = {
    "structured": """You are analyzing kinship relationships in a family. Read the context carefully and answer the question by showing your complete reasoning process.

Context:
{context}

Question: {question}

Please think through this step-by-step:

STEP 1 - IDENTIFY KEY PERSON(S):
Who is the question asking about? What relationship are we looking for?

STEP 2 - EXTRACT RELEVANT FACTS:
List the specific family relationships from the context that are relevant.

STEP 3 - TRACE THE REASONING CHAIN:
Work through the relationships step by step. Show each connection.

STEP 4 - APPLY CULTURAL RULES (if mentioned):
If the context mentions any specific kinship system rules (like clan membership, classificatory relationships, or cultural terminology), apply them here.

STEP 5 - FINAL ANSWER:
Based on your reasoning, state ONLY the answer (name(s), number, or relationship term). Do not restate the question.

IMPORTANT: End your response with exactly this format:
FINAL ANSWER: [your answer here]

Begin your analysis:""",
    "simple": """Read the family information below and answer the question. Think through your reasoning carefully before giving your final answer.

Context:
{context}

Question: {question}

Think step by step, then end your response with exactly:
FINAL ANSWER: [your answer]

Let me work through this step by step:""",
    "cultural": """You are analyzing kinship relationships. This question involves a specific cultural kinship system that may differ from Western conventions.

Context:
{context}

Question: {question}

Please analyze this carefully:

1. WHAT KINSHIP SYSTEM is being used here? (Look for clues like clan names, classificatory terms, etc.)

2. HOW DOES THIS SYSTEM DIFFER from standard Western/English kinship terms?

3. TRACE THE RELATIONSHIPS step by step, applying the cultural rules mentioned.

4. State ONLY the answer (name(s), number, or relationship term).

IMPORTANT: End your response with exactly this format:
FINAL ANSWER: [your answer here]

Begin:""",
}
FEW_SHOT = """You are analyzing kinship relationships in families. Below are some examples showing how to reason through kinship questions, followed by a new question for you to solve.

{examples}
--- Now solve this question ---
Context: {context}

Question: {question}

Think through this step by step, then give your FINAL ANSWER on the last line.

Begin:"""
EXAMPLE = """
--- Example {number} ---
Context: {context}
Question: {question}
Reasoning: {reasoning}
FINAL ANSWER: {answer}
"""

#: Examples shown in a prompt, at most.
SHOWN = 3


def filled(wording: str, **parts: Column) -> Column:
    """A wording with its fields filled from columns (null: empty), cut at plan time so that filled-in text is never searched for fields."""
    out, rest = [], wording
    while rest:
        at = min((rest.find(f"{{{k}}}") for k in parts if f"{{{k}}}" in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        out += [F.lit(rest[:at])] * (at > 0) + [F.coalesce(parts[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def rule_table(spark: SparkSession) -> DataFrame:
    """system, rule."""
    return spark.createDataFrame(list(RULES.items()), "system string, rule string")


def example_texts(examples: DataFrame) -> DataFrame:
    """category (null: for categories without examples of their own), examples: up to SHOWN example blocks joined in their order. examples has a column place."""
    block = lambda k: filled(EXAMPLE, number=k, context=F.col("context"), question=F.col("question_text"), reasoning=F.col("reasoning"), answer=F.col("answer"))
    shown = lambda df, *by: df.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "context", "question_text", "reasoning", "answer"))), 1, SHOWN).alias("xs"))
    of = lambda df: df.select("category", F.posexplode("xs").alias("k", "x")).select("category", "k", "x.*").select("category", "k", block(F.col("k") + 1).alias("text")).groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda y: y["text"]), "").alias("examples"))
    mine = shown(examples, "category")
    rest = shown(examples).withColumn("category", F.lit(None).cast("int")).select("category", "xs")
    return of(mine.filter("category is not null").select("category", "xs")).unionByName(of(rest))


def with_prompts(questions: DataFrame, protocol: str = "zero_shot_direct", style: str = "structured", rules: bool = False, examples: DataFrame | None = None, original: bool = False, out: str = "prompt") -> DataFrame:
    """questions (question_text, context, category, kinship_system) with a prompt each.

    zero_shot_direct may carry its system's rule text; zero_shot_cot has three styles; few_shot_cot shows up to three examples of the question's category, else the first three of all. An unknown style is structured, an unknown protocol direct. original takes a relabelled question's rule from its original system."""
    parts = {"context": F.col("context"), "question": F.col("question_text")}
    if protocol == "zero_shot_cot":
        return questions.withColumn(out, filled(STYLES.get(style, STYLES["structured"]), **parts))
    if protocol == "few_shot_cot":
        texts = example_texts(examples) if examples is not None else None
        if texts is None:
            return questions.withColumn(out, filled(FEW_SHOT, examples=F.lit(""), **parts))
        # A few categories: one row each.
        mine = F.broadcast(texts.filter("category is not null").select(F.col("category").alias("__cat"), F.col("examples").alias("__mine")))
        rest = F.broadcast(texts.filter("category is null").select(F.col("examples").alias("__rest")))
        df = questions.join(mine, F.coalesce("category", F.lit(1)) == F.col("__cat"), "left").join(rest, F.lit(True), "left")
        return df.withColumn(out, filled(FEW_SHOT, examples=F.coalesce("__mine", "__rest"), **parts)).drop("__cat", "__mine", "__rest")
    if not rules:
        return questions.withColumn(out, filled(DIRECT, rule=F.lit(""), **parts))
    system = F.lower(F.coalesce("kinship_system_original", "kinship_system") if original else F.col("kinship_system"))
    table = F.broadcast(rule_table(questions.sparkSession).select(F.col("system").alias("__system"), F.concat(F.lit("Cultural Rule: "), "rule", F.lit("\n\n")).alias("__rule")))
    return questions.join(table, system == F.col("__system"), "left").withColumn(out, filled(DIRECT, rule=F.col("__rule"), **parts)).drop("__system", "__rule")
