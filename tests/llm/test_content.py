"""What line de-duplication leaves of a document."""

from barline.llm import lines


def test_documents_go_only_without_a_line(spark):
    licence = "This text may be copied by all who keep this line"
    docs = {1: licence, 2: f"Red rose\n{licence}\nblue sea\n\nsun", 3: f"{licence}\n \n\t", 4: "", 5: None, 6: " \n", 7: f"{licence}\n語", 8: "sun\nblue sea"}
    found = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    got = {r.doc_id: r.text for r in lines.with_content(found).collect()}
    assert got == {1: licence, 2: "Red rose\nblue sea\n\nsun", 4: "", 5: None, 6: " \n", 7: "語"}
