"""Software inventories and vulnerabilities of a fleet, on Spark."""
