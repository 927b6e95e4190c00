"""dqengine: dataset-quality analytics on Spark DataFrames."""
