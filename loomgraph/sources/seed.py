"""A small seed graph of a university, loaded through statements and correlated merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import SparkSession

from loomgraph.operators import merge
from loomgraph.operators.graph import Graph

#: The titles of the nodes of each label.
NODES = {
    "Department": ("Faculty of Computer Science and Management", "Faculty of Electronics", "Faculty of Mathematics", "Faculty of Mechanical Engineering", "Faculty of Civil Engineering"),
    "Professor": ("Prof. Jan Kowalski", "Prof. Anna Wiśniewska", "Prof. Marek Zielinski", "Prof. Katarzyna Nowak", "Prof. Tomasz Lewandowski", "Prof. Ewa Dabrowska", "Dr. Piotr Szymanski", "Dr. Monika Wojcik"),
    "Course": ("Introduction to Artificial Intelligence", "Algorithms and Data Structures", "Digital Signal Processing", "Mathematical Analysis", "Numerical Methods", "Robotics and Automation", "Database Systems", "Cybersecurity Fundamentals", "Machine Learning", "Computer Networks"),
    "Program": ("Computer Science BSc", "Computer Science MSc", "Electronics and Telecommunications BSc", "Robotics MSc", "Applied Mathematics BSc"),
    "Building": ("Building C-3", "Building C-5", "Building A-1"),
    "Room": ("Room 104 C-3", "Lab 301 C-3", "Room 202 C-5", "Aula A-1"),
    "Research": ("Deep Learning for Medical Image Analysis", "Graph Neural Networks for Knowledge Graphs", "Autonomous Mobile Robot Navigation", "Post-Quantum Cryptography Implementation"),
}
#: Types with the labels of their ends, and the edges as numbers of nodes in the lists above, from 1.
EDGES = {
    ("BELONGS_TO", "Professor", "Department"): ((1, 1), (2, 1), (8, 1), (3, 2), (7, 2), (4, 3), (5, 4), (6, 5)),
    ("TEACHES", "Professor", "Course"): ((1, 1), (1, 9), (2, 2), (3, 3), (4, 4), (4, 5), (5, 6), (8, 7), (7, 8), (2, 10)),
    ("PART_OF", "Course", "Program"): ((1, 1), (2, 1), (7, 1), (10, 1), (9, 2), (3, 3), (8, 3), (6, 4), (4, 5), (5, 5)),
    ("OFFERED_BY", "Program", "Department"): ((1, 1), (2, 1), (3, 2), (4, 4), (5, 3)),
    ("LOCATED_IN", "Room", "Building"): ((1, 1), (2, 1), (3, 2), (4, 3)),
    ("SUPERVISES", "Professor", "Research"): ((1, 1), (1, 2), (5, 3), (7, 4)),
    ("PREREQUISITE_FOR", "Course", "Course"): ((4, 5), (2, 1), (1, 9), (7, 9)),
}


def _nodes(spark: SparkSession, label: str, titles: tuple[str, ...], graph: Graph) -> Graph:
    text = "|".join(f"MERGE (n{i}:{label} {{title: '{t}', context: '{label} {i}'}})" for i, t in enumerate(titles, 1))
    return merge.merge_batches(graph, merge.statement_rows(spark.createDataFrame([(label, text)], "batch string, text string")))


def _edges(spark: SparkSession, kind: str, a: str, b: str, pairs: tuple[tuple[int, int], ...], graph: Graph) -> Graph:
    rows = [(kind, a, NODES[a][i - 1], b, NODES[b][j - 1]) for i, j in pairs]
    return merge.merge_by_titles(graph, spark.createDataFrame(rows, "type string, src_label string, src_title string, dst_label string, dst_title string"))


def blocks(spark: SparkSession) -> list[Callable[[Graph], Graph]]:
    """A block of writes for each label and for each type, in order; loading them again changes nothing."""
    return [*(partial(_nodes, spark, label, titles) for label, titles in NODES.items()), *(partial(_edges, spark, *kind, pairs) for kind, pairs in EDGES.items())]
