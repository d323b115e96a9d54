"""notemill: annotated text corpora, their datasets and their scores, as Spark jobs.

Every public function takes DataFrames and returns DataFrames; none creates a
session. See README.md for the map from task to module.
"""

__version__ = "0.1.0"
