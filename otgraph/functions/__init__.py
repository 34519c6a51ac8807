"""Column-level helpers: every function takes and returns ``Column`` expressions (JVM-side)."""

from otgraph.functions.iri import *  # noqa: F401,F403
from otgraph.functions.events import *  # noqa: F401,F403
from otgraph.functions.formulas import *  # noqa: F401,F403
