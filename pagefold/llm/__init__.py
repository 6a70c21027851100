"""Training-data operators: tokenizing, deduplication, classification, decontamination, archives.

Nothing else in the library imports this subpackage.  Its functions are shipped to the Python
workers by value, so a cluster needs only the driver to have the package installed.
"""

import sys

from pagefold.session import register_by_value

register_by_value(sys.modules[__name__])
