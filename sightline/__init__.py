"""Spark operators for curating, sampling and evaluating 2-D point labels.

Items (images, events, readings) belong to groups ("dives"), carry a labelled
point and, later, a predicted one.  Everything is a lazy ``DataFrame ->
DataFrame`` function unless its docstring says it runs a job.
"""

__version__ = "0.1.0"
