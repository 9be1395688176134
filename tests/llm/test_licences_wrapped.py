from odd import documents

from corvane.llm import licences

BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = """// Permission is hereby granted, free of charge, to any person obtaining
// a copy of this software and associated documentation files (the
// "Software"), to deal in the Software without restriction"""
DUAL = "Licensed under either the MIT License or the Apache License, Version 2.0, at your option."


def test_wrapped_and_dual_notices(spark, sf):
    want = {200: (BSD, "bsd"), 201: (GPL, "gpl"), 202: (MIT, "mit"), 203: (DUAL, "apache,mit"), 204: (f"int x;\n\n{BSD}\n\nsome words\n{GPL}", "bsd,gpl"), 205: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 206: ("Permission is hereby granted\n\nto the driver of the car", "")}
    model = licences.model(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = documents(spark, [(i, t) for i, (t, _) in want.items()])
    rows = {r.doc_id: r for r in licences.licence_findings(docs, model).withColumn("said", licences.families()).collect()}
    assert {i: rows[i].said for i in want} == {i: f for i, (_, f) in want.items()}
    assert [(x.line, x.family) for x in rows[204].licences if x.confirmed] == [(2, "bsd"), (8, "gpl")]
