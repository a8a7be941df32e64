"""Training-data operators. Nothing outside this subpackage (and the guarded
import in ``__spark_entry__``) may import it."""
