"""lotweave: a PySpark engine that assigns land parcels to administrative units.

Free-text ledgers are expanded into lots, joined to parcel keys with prioritised lookups, turned into unit geometry,
indexed and audited. Everything is declared as DataFrame plans.
"""

__version__ = "0.1.0"
