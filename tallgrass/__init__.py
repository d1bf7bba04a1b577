"""tallgrass: a PySpark-native engine for curating, grading and analysing text corpora.

Sub-packages
------------
sources     readers, writers, schemas, checkpoints and manifests
functions   column expressions and Arrow functions over text, boxes and answers
operators   relational building blocks (reject chains, sampling, votes, windows, packed values)
plans       named queries built from the operators, each with SQL where SQL can say it
streaming   incremental versions of the batch plans
llm         operators for training-data pipelines; nothing outside imports it
"""

__version__ = "0.1.0"
