"""Training-data operators: scoring, filtering, near-duplicate removal, packing.

Nothing outside this subpackage imports it.  Every operator keeps its working
data in Spark DataFrames; numpy runs inside tasks on bounded chunks only.
"""
