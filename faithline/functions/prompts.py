"""Prompt assembly: parts joined by blank lines. The wording is this package's own; the parts and their order are the task's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tools import SPECS

#: How strongly the answer is tied to the structure.
REGIMES = {
    "standard": "",
    "detailed": "The structure above determines your answer. Derive the answer from the structure and from nothing else.",
    "max_detailed": "The structure above determines your answer. Derive the answer from the structure and from nothing else, even if you find the structure to be wrong: it may have been changed, and the changed one counts.",
}
#: dataset -> (task, form of the structure, form of the answer, what the answer begins with).
TASKS = {
    "ricechem": ("Grade a student's answer to a chemistry task by its rubric.", "Checklist:\n<item> (True/False): <True or False>", "Final grade (<range>): <number>", "Final grade"),
    "averitec": ("Judge a claim by answering the questions about it.", "Checklist:\n- Q: <question> (True/False): <True or False>", "Final Verdict: <Supported or Refuted>", "Final Verdict:"),
    "tabfact": ("Check a statement against a table with a query of the table language.", "Verifier Query: <query>=<True or False>", "Execution Result: <True or False>", "Execution Result:"),
    "cruxeval": ("Follow a function line by line and tell what it returns.", "Trace:\nline <number>:\n  <name> = <value>", "Final Answer: <value>", "Final Answer:"),
}
#: dataset -> (sample, structure, answer) of worked examples.
EXAMPLES = {
    "ricechem": (("Task: Why does ice float?\nStudent answer: It is lighter than water.\nScore range: 0-2", "Checklist:\nnames density (True/False): True\nexplains the lattice (True/False): False", "Final grade (0-2): 1"),),
    "averitec": (("Claim: The bridge was opened in 1932.", "Checklist:\n- Q: Was the bridge opened in 1932? (True/False): True", "Final Verdict: Supported"),
                 ("Claim: The lake is the deepest of the country.", "Checklist:\n- Q: Is no other lake of the country deeper? (True/False): False", "Final Verdict: Refuted")),
    "tabfact": (("Table:\ncity#people\nalba#300\nbrea#500\nStatement: brea has the most people", "Verifier Query: eq{hop{argmax{all_rows; people}; city}; brea}=True", "Execution Result: True"),),
    "cruxeval": (("def f(x):\n    y = x + 1\n    return y * 2\nInput: 3", "Trace:\nline 2:\n  x = 3\nline 3:\n  x = 3\n  y = 4", "Final Answer: 8"),),
}
BASELINE_PREFIX = {"ricechem": "Grade:", "averitec": "Verdict:", "tabfact": "Result:"}


def instruction(dataset: str, mode: str = "none") -> str:
    """A dataset's instruction: the task, the form of the structure, and that of the answer or of the tool call."""
    task, structure, answer, _ = TASKS[dataset]
    last = f"Then give the answer:\n{answer}" if mode == "none" else f"Then call the tool:\nTOOL: <name>\nARGS: <arguments as JSON>\n\nThe tool:\n{SPECS[dataset, mode]}"
    return f"{task}\n\nFirst write the structure:\n{structure}\n\n{last}"


def few_shot(dataset: str, mode: str = "none", n: int | None = None) -> tuple[str, ...]:
    """Worked examples in the form that the mode asks for."""
    import json

    out = []
    for sample, structure, answer in EXAMPLES[dataset][:n]:
        if mode != "none":
            body = structure.partition("\n")[2] or structure.partition(": ")[2]
            argument = {"ricechem": "rubric", "averitec": "rubric", "tabfact": "query", "cruxeval": "trace"}[dataset]
            value: object = body
            if mode == "structured" and argument == "rubric":
                value = [line.endswith("True") for line in body.splitlines()]
            answer = f"TOOL: {json.loads(SPECS[dataset, mode])['name']}\nARGS: {json.dumps({argument: value}, ensure_ascii=False)}"
        out.append(f"{sample}\n\n{structure}\n\n{answer}")
    return tuple(out)


def prompt(instruction: str, sample: Column, regime: str = "standard", tool: str | None = None, few_shot: tuple[str, ...] = ()) -> Column:
    head = "\n\n".join(x for x in (instruction, tool, REGIMES[regime], *few_shot) if x)
    return F.concat_ws("\n\n", F.lit(head), sample)


def dataset_prompt(dataset: str, sample: Column, regime: str = "standard", mode: str = "none", examples: int | None = None) -> Column:
    return prompt(instruction(dataset, mode), sample, regime, few_shot=few_shot(dataset, mode, examples))


def baseline_prompt(dataset: str, sample: Column) -> Column:
    """A prompt without a structure, which ends where the answer begins."""
    return F.concat_ws("\n\n", F.lit(f"{TASKS[dataset][0]} Give the answer alone."), sample, F.lit(BASELINE_PREFIX[dataset]))


def with_structure(base: Column, structure: Column, prefix: str) -> Column:
    """A prompt that goes on with the (edited) structure and the beginning of the answer."""
    return F.concat(base, F.lit("\n\n"), structure, F.lit("\n"), F.lit(prefix))


def answer_prefix(dataset: str, mode: str = "none") -> str:
    return TASKS[dataset][3] if mode == "none" else "TOOL:"


def checklist_text(checklist: Column, bullet: str = "- Q: ") -> Column:
    lines = F.transform(checklist, lambda x: F.concat(F.lit(bullet), x["item"], F.lit(" (True/False): "), F.when(x["answer"], "True").otherwise("False")))
    return F.concat(F.lit("Checklist:\n"), F.array_join(lines, "\n"))
