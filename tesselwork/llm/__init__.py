"""Training-data operators: token counts, quotation linking, decontamination,
quality scoring, source mixing, near and exact duplicate removal, line rules
and HTML extraction.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code: no machine needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
