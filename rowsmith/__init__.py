"""rowsmith: relational table jobs on the Spark DataFrame API.

Every public function takes and returns a ``DataFrame`` (or a ``Column``) and
leaves physical planning to Catalyst; nothing here collects table data to the
driver.
"""

__version__ = "0.1.0"
