"""wattline: power and gas market analytics as lazy Spark plans."""
