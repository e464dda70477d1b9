"""fraudlens: review-fraud analytics as Spark DataFrame and ML jobs.

Sub-packages
------------
sources    readers (headerless TSV), fixture adapters, sinks, previews
functions  column expressions (label maps, text stats, time gaps, grids)
operators  joins, sampling, behavioural features, transforms, graphs,
           clustering, text embedding, models, search, evaluation
plans      end-to-end pipelines and the query registry
"""

__version__ = "0.1.0"
