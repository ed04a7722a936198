"""python -m hexnet: look at and build networks.

    stats PATH                       numbers of nodes, edges and shortcuts
    features PATH OUT                a table of lines for edges and shortcuts
    covered-area PATH WIDTH OUT      outlines of the cells, as WKB
    from-ways NODES WAYS WIDTH SIZE OUT [PROFILE]   a network from Parquet tables of nodes and ways
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .functions import geo
from .functions.lattice import Lattice
from .operators import graph as g
from .sources import graphs, osm


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if args else 2
    spark = SparkSession.builder.getOrCreate()
    command, *rest = args
    if command == "stats":
        print("\n".join(f"{k}: {v}" for k, v in g.stats(graphs.read(spark, rest[0])).first().asDict().items()))
    elif command == "features":
        g.features(graphs.read(spark, rest[0])).write.parquet(rest[1])
    elif command == "covered-area":
        geo.covered_area(graphs.read(spark, rest[0]), Lattice(int(rest[1]))).write.parquet(rest[2])
    elif command == "from-ways":
        nodes, ways = (spark.read.parquet(p) for p in rest[:2])
        graphs.write(osm.build_graph(nodes, ways, Lattice(int(rest[2]), float(rest[3])), *rest[5:6]), rest[4])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
